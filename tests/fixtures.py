"""Small inputs of this repository's own making."""

import json
from pathlib import Path

# The order of the rows counts, not their numbers.
LAYOUT_CSV = """ColID,Column_Name , DataTtype,Length,Type,IsSensitive,Block_ID
12,label,varchar,3,HDR,,
11,region,varchar,4,HDR,,
10,cycle,varchar,2,HDR,,
9,tag,varchar,2,DE,,
8,unit,varchar,3,DE,Y,
7,grade,varchar,2,DE,,
6,net_amount_due,varchar,9,DE,,
5,due,varchar,8,DE,,
"""

# Two control lines, a character of two bytes, a line without a date, a short line, no trailer.
LINES = [
    "HX7NORD21",
    "CD001 start of batch   ",
    "DEä41B 00000250K20190630",
    "DE305A 00001    ",
    "DE77 C200000125}20181231",
    "DE9",
    "CD002 end 1 \t",
]
CONTROL_LINES = ["CD001 start of batch", "CD002 end 1"]

SYNTHETIC_ROWS = [
    ("DE", "ü1", "C2", "00000125}", "2018-12-31"),
    ("DE", "77", "B", "17", None),
    ("DF", "305", "A9", "00001", "2020-02-29"),
]

RENDERED = (
    "HX7NORD21\n"
    "DEü1 C200000125}20181231\n"
    "DE77 B 17               \n"
    "DF305A900001    20200229\n"
    "CD001 start of batch\n"
    "CD002 end 1\n"
    "PT000000000300000000000A00000000000G00000000000D\n"
)

DETAIL_CSV = (
    "tag,unit,grade,net_amount_due,due\n"
    "DE,ä41,B,00000250K,2019-06-30\n"
    "DE,305,A,00001,\n"
    "DE,77,C2,00000125},2018-12-31\n"
    "DE,9,,,\n"
)

HEADER_NAMES = ["label", "region", "cycle"]
HEADER_VALUES = ("HX7", "NORD", "21")
HEADER_COLUMNS = {c: {"sdtype": "categorical"} for c in HEADER_NAMES}
DATA_COLUMNS = {
    **{c: {"sdtype": "categorical"} for c in ("tag", "unit", "grade", "net_amount_due")},
    "due": {"sdtype": "datetime", "datetime_format": "%Y%m%d"},
}


def write_layout(folder):
    path = Path(folder) / "layout.csv"
    path.write_text(LAYOUT_CSV)
    return str(path)


def write_sample(folder, name="claims.txt", lines=LINES):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))
    return str(path)


def write_metadata(folder, kind, columns, version):
    path = Path(folder) / f"meta_{kind}_v{version}.json"
    document = {"METADATA_SPEC_VERSION": "SINGLE_TABLE_V1", "columns": columns}
    path.write_text(json.dumps(document, indent=4))
    return str(Path(folder) / "meta")
