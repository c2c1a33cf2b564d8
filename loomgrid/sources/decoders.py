"""Pure decoders: bytes of one file to records (ordered dicts of text, or None). No Spark here."""

from __future__ import annotations

import base64
import html
import io
import json
import math
import os
import re
import sqlite3
import struct
import tempfile
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from itertools import islice

Record = dict[str, str | None]


def text_of(v: object) -> str | None:
    """A value as text; nested values as JSON, bytes as UTF-8 or base64, times as RFC 3339."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, bytes):
        try:
            return v.decode("utf-8")
        except UnicodeDecodeError:
            return base64.b64encode(v).decode()
    if isinstance(v, datetime):
        return v.astimezone(UTC).isoformat().replace("+00:00", "Z") if v.tzinfo else v.isoformat()
    if isinstance(v, (dict, list)):
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=text_of)
    return str(v)


def rows_of(v: object) -> Iterator[Record]:
    """A list of maps is a table; other values become a column ``value``."""
    for x in v if isinstance(v, list) else [v]:
        yield {str(k): text_of(y) for k, y in x.items()} if isinstance(x, dict) else {"value": text_of(x)}


def decode_text(raw: bytes) -> str:
    """UTF-8 or UTF-16 by byte order mark; else UTF-8, else Latin-1 if there is no NUL byte."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        if b"\0" in raw:
            raise ValueError("neither text in a known encoding nor marked UTF-16") from None
        return raw.decode("latin-1")


def json_array(raw: bytes) -> Iterator[Record]:
    data = json.loads(decode_text(raw))
    if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
        raise ValueError("an array of objects is expected")
    return rows_of(data)


def ndjson(raw: bytes) -> Iterator[Record]:
    """Objects one after another; a record may span lines."""
    text, at, dec = decode_text(raw), 0, json.JSONDecoder()
    while (m := re.compile(r"\s*").match(text, at)).end() < len(text):
        v, at = dec.raw_decode(text, m.end())
        yield from rows_of([v])


def yaml_list(raw: bytes) -> Iterator[Record]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the PyYAML package") from e
    data = yaml.safe_load(decode_text(raw))
    if not isinstance(data, list):
        raise ValueError("a list of maps is expected")
    return rows_of(data)


def toml(raw: bytes) -> Iterator[Record]:
    data = tomllib.loads(decode_text(raw))
    tables = next((v for v in data.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)), None)
    return rows_of(tables if tables is not None else [data])


def ini(raw: bytes) -> Iterator[Record]:
    section: Record = {"section": "(default)"}
    for line in decode_text(raw).splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            if len(section) > 1 or section["section"] != "(default)":
                yield section
            section = {"section": line[1:-1].strip()}
        elif m := re.match(r"([^=:]+)[=:](.*)$", line):
            v = m[2].strip()
            section[m[1].strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    if len(section) > 1 or section["section"] != "(default)":
        yield section


def result_xml(raw: bytes) -> Iterator[Record]:
    """The <result><rows><row><cell name=...> form that the XML sink writes."""
    root = ET.fromstring(raw)
    names = [c.get("name") or (c.text or "") for c in root.iterfind("./columns/column")]
    for row in root.iterfind("./rows/row"):
        own = {c.get("name", ""): c.text for c in row.iterfind("cell")}
        yield {n: own.get(n) for n in names or own}


def fixed_width(raw: bytes) -> Iterator[Record]:
    """Columns are the maximal runs of positions that some line fills; the first line names them."""
    lines = [x.rstrip("\r") for x in decode_text(raw).split("\n") if x.strip()]
    if not lines:
        return
    width = max(map(len, lines))
    used = [any(i < len(x) and not x[i].isspace() for x in lines) for i in range(width)]
    spans = [m.span() for m in re.finditer("1+", "".join("1" if u else "0" for u in used))]
    cut = lambda x: [x[a:b].strip() for a, b in spans]
    head = cut(lines[0])
    for x in lines[1:]:
        yield dict(zip(head, cut(x)))


def html_tables(raw: bytes) -> Iterator[Record]:
    text = decode_text(raw)
    for t, table in enumerate(re.findall(r"<table\b[^>]*>(.*?)</table>", text, re.I | re.S), 1):
        for r, row in enumerate(re.findall(r"<tr\b[^>]*>(.*?)</tr>", table, re.I | re.S), 1):
            cells = re.findall(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", row, re.I | re.S)
            if cells:
                clean = (html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", "\n", c, flags=re.I))).strip() for c in cells)
                yield {"table_index": str(t), "row_index": str(r), **{f"col_{i}": c for i, c in enumerate(clean, 1)}}


def _components(raw: bytes, kinds: tuple[str, ...]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    kind, props = None, []
    for line in re.sub(r"\r?\n[ \t]", "", decode_text(raw)).splitlines():
        name, _, value = line.partition(":")
        name = name.split(";")[0].strip().upper()
        if name == "BEGIN" and value.strip().upper() in kinds:
            kind, props = value.strip().upper(), []
        elif name == "END" and kind and value.strip().upper() == kind:
            yield kind, props
            kind = None
        elif kind and name:
            props.append((name, re.sub(r"\\([,;\\])", r"\1", value.replace("\\n", "\n"))))


def _first(props: list[tuple[str, str]], *names: str) -> str:
    return next((v for n in names for k, v in props if k == n), "")


def _all(props: list[tuple[str, str]]) -> str:
    out: dict[str, list[str]] = {}
    for k, v in props:
        out.setdefault(k, []).append(v)
    return json.dumps({k: "; ".join(v) for k, v in sorted(out.items())}, ensure_ascii=False)


def icalendar(raw: bytes) -> Iterator[Record]:
    for kind, p in _components(raw, ("VEVENT", "VTODO")):
        yield {
            "component": kind, "summary": _first(p, "SUMMARY"), "start": _first(p, "DTSTART", "DUE"), "end": _first(p, "DTEND"), "uid": _first(p, "UID"),
            "location": _first(p, "LOCATION"), "description": _first(p, "DESCRIPTION"), "properties": _all(p),
        }


def vcard(raw: bytes) -> Iterator[Record]:
    for _, p in _components(raw, ("VCARD",)):
        many = lambda n, p=p: "; ".join(v for k, v in p if k == n)
        yield {
            "full_name": _first(p, "FN"), "name": _first(p, "N"), "organization": _first(p, "ORG"), "title": _first(p, "TITLE"),
            "email": many("EMAIL"), "tel": many("TEL"), "url": many("URL"), "properties": _all(p),
        }


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the data ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def num(self, fmt: str) -> int | float:
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]


def _msgpack(r: _Reader) -> object:
    b = r.take(1)[0]
    if b < 0x80:
        return b
    if b >= 0xE0:
        return b - 256
    if b < 0x90:
        return {str(_msgpack(r)): _msgpack(r) for _ in range(b & 15)}
    if b < 0xA0:
        return [_msgpack(r) for _ in range(b & 15)]
    if b < 0xC0:
        return r.take(b & 31).decode()
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b]
    sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if b in numbers:
        return r.num(numbers[b])
    if b not in sizes:
        raise ValueError(f"MessagePack type {b:#x} is not supported")
    n = int(r.num(sizes[b]))
    if b <= 0xC6:
        return r.take(n)
    if b <= 0xDB:
        return r.take(n).decode()
    if b <= 0xDD:
        return [_msgpack(r) for _ in range(n)]
    return {str(_msgpack(r)): _msgpack(r) for _ in range(n)}


def msgpack(raw: bytes) -> Iterator[Record]:
    return rows_of(_msgpack(_Reader(raw)))


def _cbor(r: _Reader) -> object:
    b = r.take(1)[0]
    major, low = b >> 5, b & 31
    if major == 7:
        if low in (20, 21, 22):
            return {20: False, 21: True, 22: None}[low]
        if low in (26, 27):
            return r.num(">f" if low == 26 else ">d")
        raise ValueError(f"CBOR simple value {low} is not supported")
    if low > 27 or major == 6:
        raise ValueError("CBOR tags and indefinite lengths are not supported")
    n = low if low < 24 else int(r.num({24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[low]))
    if major < 2:
        return n if major == 0 else -1 - n
    if major == 2:
        return r.take(n)
    if major == 3:
        return r.take(n).decode()
    if major == 4:
        return [_cbor(r) for _ in range(n)]
    return {str(text_of(_cbor(r))): _cbor(r) for _ in range(n)}


def cbor(raw: bytes) -> Iterator[Record]:
    return rows_of(_cbor(_Reader(raw)))


def _bson(r: _Reader, array: bool = False) -> object:
    end = r.at + int(r.num("<i"))
    out: dict = {}
    while (kind := r.take(1)[0]) != 0:
        stop = r.raw.index(b"\0", r.at)
        name = r.take(stop - r.at).decode()
        r.take(1)
        if kind == 1:
            v: object = r.num("<d")
        elif kind == 2:
            v = r.take(int(r.num("<i")))[:-1].decode()
        elif kind in (3, 4):
            v = _bson(r, kind == 4)
        elif kind == 5:
            n = int(r.num("<i"))
            r.take(1)
            v = r.take(n)
        elif kind == 7:
            v = r.take(12).hex()
        elif kind == 8:
            v = r.take(1) != b"\0"
        elif kind == 9:
            v = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=int(r.num("<q")))
        elif kind == 10:
            v = None
        elif kind in (16, 18):
            v = r.num("<i" if kind == 16 else "<q")
        else:
            raise ValueError(f"BSON type {kind:#x} is not supported")
        out[name] = v
    if r.at != end:
        raise ValueError("a BSON document has a wrong length")
    return list(out.values()) if array else out


def bson(raw: bytes) -> Iterator[Record]:
    r = _Reader(raw)
    while r.at < len(raw):
        yield from rows_of([_bson(r)])


class opened_sqlite:
    """A database of given bytes, in memory if this SQLite can do so."""

    def __init__(self, raw: bytes):
        self.db = sqlite3.connect(":memory:")
        try:
            self.db.deserialize(raw)
        except (AttributeError, sqlite3.Error):
            self.file = tempfile.NamedTemporaryFile(suffix=".db")
            self.file.write(raw)
            self.file.flush()
            self.db = sqlite3.connect(self.file.name)

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *_: object) -> None:
        self.db.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_tables(raw: bytes) -> Iterator[Record]:
    with opened_sqlite(raw) as db:
        names = [x[0] for x in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for t in names:
            cur = db.execute(f"SELECT * FROM {quoted(t)}")
            cols = [c[0] for c in cur.description]
            for row in cur:
                yield {"source_table": t, **{c: text_of(v) for c, v in zip(cols, row)}}


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ENTRY_LIMIT = 128 << 20


def _part(z: zipfile.ZipFile, name: str) -> ET.Element:
    """A part that is read whole: the workbook and its relations, never sheets or strings."""
    if z.getinfo(name).file_size > ENTRY_LIMIT:
        raise ValueError(f"{name} is larger than {ENTRY_LIMIT} bytes")
    return ET.fromstring(z.read(name))


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements of one tag while a part of any size is unpacked; what has been passed is dropped from the tree."""
    parser, root = ET.XMLPullParser(["start"]), None
    with z.open(name) as part:
        while chunk := part.read(1 << 16):
            parser.feed(chunk)
            for _, e in parser.read_events():
                root = e if root is None else root
            if root is not None:
                yield from _passed(root, tag, False)
    parser.close()
    yield from _passed(root, tag, True)


def _passed(top: ET.Element, tag: str, closed: bool) -> Iterator[ET.Element]:
    """Removes what is complete below an element; of an open one, the last child may be open too."""
    done = len(top) if closed else max(0, len(top) - 1)
    for e in top[:done]:
        if e.tag == tag:
            yield e
        else:
            yield from _passed(e, tag, True)
    if done < len(top) and top[done].tag != tag:
        yield from _passed(top[done], tag, False)
    del top[:done]


class stored_strings:
    """Strings by number: their bytes in a temporary file, only their ends in memory."""

    def __init__(self, strings: Iterator[str]):
        self.file, self.ends = tempfile.TemporaryFile(), array("Q", [0])
        for s in strings:
            self.ends.append(self.ends[-1] + self.file.write(s.encode()))
        self.file.flush()

    def __getitem__(self, i: int) -> str:
        return os.pread(self.file.fileno(), self.ends[i + 1] - self.ends[i], self.ends[i]).decode()

    def __enter__(self) -> stored_strings:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


@lru_cache(20_000)
def _column(ref: str) -> int | None:
    letters = re.match("[A-Z]+", ref)
    return sum((ord(ch) - 64) * 26**i for i, ch in enumerate(letters[0][::-1])) - 1 if letters else None


def _rows(z: zipfile.ZipFile, path: str, shared: stored_strings) -> Iterator[list[str]]:
    for row in _elements(z, path, _X + "row"):
        cells: list[str] = []
        for c in row.iter(_X + "c"):
            at = _column(c.get("r", "").rstrip("0123456789"))
            at = len(cells) if at is None else at
            cells += [""] * (at + 1 - len(cells))
            v, kind = c.find(_X + "v"), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join([t.text or "" for t in c.iter(_X + "t")])
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text
        yield cells


def xlsx(raw: bytes) -> Iterator[Record]:
    """All sheets under the header of the first that is not empty; with several sheets, a column ``sheet``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        items = _elements(z, "xl/sharedStrings.xml", _X + "si") if "xl/sharedStrings.xml" in z.namelist() else ()
        with stored_strings("".join(t.text or "" for t in si.iter(_X + "t")) for si in items) as shared:
            rels = {r.get("Id"): r.get("Target", "") for r in _part(z, "xl/_rels/workbook.xml.rels")}
            found = []
            for sheet in _part(z, "xl/workbook.xml").iter(_X + "sheet"):
                path = rels.get(sheet.get(_REL), "").lstrip("/")
                path = path if path.startswith("xl/") else f"xl/{path}"
                if (head := next(_rows(z, path, shared), None)) is not None:
                    found.append((sheet.get("name", ""), path, head))
            for name, path, _ in found:
                for row in islice(_rows(z, path, shared), 1, None):
                    rec = {h or f"col_{i}": (row[i - 1] if i <= len(row) else "") for i, h in enumerate(found[0][2], 1)}
                    yield {"sheet": name, **rec} if len(found) > 1 else rec


def manifest(raw: bytes, kind: str) -> Iterator[Record]:
    yield {"file_format": kind, "size_bytes": str(len(raw)), "magic": raw[:16].hex(), "note": "content is read by the columnar reader"}


def excel_serial(d: datetime) -> float:
    return (d - datetime(1899, 12, 30)) / timedelta(days=1)


def finite(v: object) -> float | None:
    try:
        x = float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None
