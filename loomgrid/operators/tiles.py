"""Tile layers: metadata, vector layer names, and what a tile's first bytes say."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.sources.geodecoders import Proto, unpack


def metadata(tiles: DataFrame) -> dict[str, str]:
    """Keys in lower case, the scheme (tms if none is named) and zoom limits checked against each other."""
    m = {r[0].lower(): r[1] for r in tiles.where("record_type = 'metadata' AND name IS NOT NULL").select("name", "value").collect()}
    m.setdefault("scheme", "tms")
    low, high = int(m.get("minzoom", 0)), int(m.get("maxzoom", 30))
    if not 0 <= low <= high <= 30:
        raise ValueError(f"zoom levels {low} to {high} are not possible")
    if "bounds" in m:
        w, s, e, n = (float(x) for x in m["bounds"].split(","))
        if not (-180 <= w <= e <= 180 and -90 <= s <= n <= 90):
            raise ValueError(f"bounds {m['bounds']} are not possible")
    return m


def is_tile_layer(df: DataFrame) -> bool:
    need = {"record_type", "zoom_level", "tile_column", "tile_row", "tile_data_base64"}
    return need <= set(df.columns) and df.where("record_type = 'tile'").limit(1).count() == 1


def is_routing_graph(df: DataFrame) -> bool:
    return {"record_type", "from_id", "to_id"} <= set(df.columns) and df.where("record_type IN ('edge', 'link')").limit(1).count() == 1


def mvt_layers(data: bytes) -> list[str]:
    """Layer names of one vector tile, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = unpack(data, 2)
    return [Proto(layer).one(1, b"").decode("utf-8", "replace") for layer in Proto(data).f.get(3, [])]


def vector_layers(tiles: DataFrame) -> list[str]:
    """From the metadata, else from one tile."""
    m = metadata(tiles)
    for text in (m.get("vector_layers"), m.get("json")):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            continue
        found = found.get("vector_layers") if isinstance(found, dict) else found
        if found:
            return [x["id"] for x in found if "id" in x]
    row = tiles.where("record_type = 'tile'").select(F.unbase64("tile_data_base64")).first()
    return mvt_layers(bytes(row[0])) if row else []


# First bytes of tile formats.
MAGIC = {"89504E47": "png", "FFD8FF": "jpg", "47494638": "gif", "52494646": "webp", "1F8B": "pbf.gz"}


def tile_format(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 4))
    out = None
    for magic, name in MAGIC.items():
        hit = head.startswith(magic)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("pbf")
