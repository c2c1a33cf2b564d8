"""loomgrid: a PySpark-native analytics workbench (sources, operators, sinks, plans, streaming)."""
