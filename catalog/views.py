"""The domain tables, derived from the generic ones by expressions both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FL_WAVELENGTH = "(200 + ((event_id * 7) % 7001) * CAST(0.1 AS DOUBLE))"
_AB_WAVELENGTH = (
    "(200 + ((l_orderkey * 7 + l_linenumber * 1009) % 7001) * CAST(0.1 AS DOUBLE))"
)
_FL = {
    "wavelength": _FL_WAVELENGTH,
    "intensity": f"value + (900 - {_FL_WAVELENGTH}) * CAST(0.2 AS DOUBLE)",
    "seq": "event_id",
}
_AB = {
    "wavelength": _AB_WAVELENGTH,
    "absorbance": "CAST(0.05 AS DOUBLE) + l_discount"
    f" + 2 * (900 - {_AB_WAVELENGTH}) / CAST(700 AS DOUBLE)",
    "o1": "l_orderkey",
    "o2": "l_linenumber",
    "o3": "l_partkey",
    "o4": "l_suppkey",
    "o5": "l_extendedprice",
}


def _digit(key: str, base: int, place: int) -> str:
    return f"(CAST(floor({key} / {place}) AS BIGINT) % {base})"


def _pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {index} {whens} END"


_N, _C = "n_nationkey", "c_custkey"
_PH_FILE = "concat(CASE WHEN {0} % 2 = 0 THEN 'A' ELSE 'B' END, CAST({0} AS VARCHAR(8)))"
_UNLESS_REF = "CASE WHEN c_custkey > 0 THEN {} END"
_CONTROL = "c_custkey % 10 = 9"


def _level(expr: str) -> str:
    return _UNLESS_REF.format(f"CAST({expr} - 1 AS DOUBLE)")


_AU, _AMP = _digit(_C, 3, 1), _digit(_C, 3, 3)
_CITR, _NAH = _digit(_C, 3, 9), _digit(_C, 3, 27)
_AZIDE = "((c_custkey + CAST(floor(c_custkey / 5) AS BIGINT)) % 3)"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # Spectra: 25 long ones, and one per user or supplier.
    "fl": ("events", {"file": "user_id % 25", **_FL}),
    "ab": ("lineitem", {"file": "l_suppkey % 25", **_AB}),
    "fu": ("events", {"file": "user_id", **_FL}),
    "au": ("lineitem", {"file": "l_suppkey", **_AB}),
    "fp": ("events", {"file": _PH_FILE.format("(user_id % 25)"), **_FL}),
    "ap": ("lineitem", {"file": _PH_FILE.format("(l_suppkey % 25)"), **_AB}),
    # Sample sheets.
    "samples": (
        "nation",
        {
            "file": f"CAST({_N} AS BIGINT)",
            "type": f"CASE WHEN {_N} = 0 THEN 'ref' ELSE 'au' END",
            "a_level": f"{_N} % 3 - 1",
            "b_level": f"{_digit(_N, 3, 3)} - 1",
        },
    ),
    "ratio": (
        "nation",
        {
            "file": f"CAST({_N} AS BIGINT)",
            "azide": f"CASE WHEN {_N} > 0 THEN {_N} * CAST(3 AS DOUBLE) END",
            "gold": f"CASE WHEN {_N} > 0 THEN CAST(30 AS DOUBLE) END",
            "n3_au": f"CASE WHEN {_N} > 0 THEN {_N} / CAST(10 AS DOUBLE) END",
            "type": f"CASE WHEN {_N} = 0 THEN 'ref' ELSE 'au' END",
        },
    ),
    "mixing": (
        "nation",
        {
            "file": f"CAST({_N} AS BIGINT)",
            "type": f"CASE WHEN {_N} = 0 THEN 'ref' ELSE 'au' END",
            "comp_1_2": f"CASE WHEN {_N} > 0 THEN "
            + _pick(f"{_N} % 6", ["Au + AMP", "Au + azide", "azide + citr", "azide + citr",
                                  "AMP + citr", "Au + citr"]) + " END",
            "comp_3": f"CASE WHEN {_N} > 0 THEN "
            + _pick(f"{_N} % 6", ["azide", "AMP", "AMP", "AMP", "azide", "AMP"]) + " END",
            "comp_4": f"CASE WHEN {_N} > 0 THEN "
            + _pick(f"{_N} % 6", ["citr", "citr", "w", "Au", "w", "azide"]) + " END",
            "comp_5": f"CASE WHEN {_N} > 0 THEN "
            + _pick(f"{_N} % 6", ["w", "w", "Au", "w", "Au", "w"]) + " END",
        },
    ),
    "ph": (
        "nation",
        {
            "file": _PH_FILE.format(_N),
            "sample": f"CASE WHEN {_N} % 2 = 0 THEN 'A' ELSE 'B' END",
            "V_sample": f"({_N} % 12 + 1) * CAST(0.2 AS DOUBLE)",
            "V_total": "CAST(3 AS DOUBLE)",
            "pH": f"CASE WHEN {_N} >= 14 THEN 3 + ({_N} % 5) * CAST(0.6 AS DOUBLE) END",
        },
    ),
    "dose": (
        "customer",
        {
            "file": _C,
            "sample": f"CASE WHEN {_C} % 2 = 0 THEN 'A' ELSE 'B' END",
            "V_Hg": f"{_digit(_C, 4, 4)} * CAST(30 AS DOUBLE)",
            "c_Hg_stock": f"CASE WHEN {_digit(_C, 4, 4)} = 3 THEN CAST(0.01 AS DOUBLE)"
            " ELSE CAST(0.001 AS DOUBLE) END",
            "pH": f"CASE WHEN {_digit(_C, 2, 2)} = 0 THEN 'low' ELSE 'high' END",
        },
    ),
    "ions": (
        "customer",
        {
            "file": _C,
            "sample": f"CASE WHEN {_C} % 2 = 0 THEN 'A' ELSE 'B' END",
            "ion": _pick(_digit(_C, 5, 2), ["ref", "Cu(II)", "Zn(II)", "Pb(II)", "Fe(III)"]),
            "pH": "'high'",
        },
    ),
    "factorial": (
        "customer",
        {
            "file": _C,
            "Au_level": _level(_AU),
            "AMP_level": _level(_AMP),
            "Citr_level": _level(_CITR),
            "NaH_level": _level(_NAH),
            "N3_level": _level(_AZIDE),
            "type": f"CASE WHEN {_C} = 0 THEN 'ref' WHEN {_CONTROL} THEN 'control'"
            f" WHEN {_C} % 10 >= 7 THEN 'au3' WHEN {_C} % 10 >= 5 THEN 'au2' ELSE 'au' END",
            "Au_conc": _UNLESS_REF.format("CAST(0.2 AS DOUBLE)"),
            "AMP_ratio": _UNLESS_REF.format(
                f"CASE WHEN {_CONTROL} AND {_AMP} = 0 THEN CAST(0 AS DOUBLE)"
                f" ELSE 20 + {_AMP} * CAST(10 AS DOUBLE) END"
            ),
            "Citr_ratio": _UNLESS_REF.format(
                f"CASE WHEN {_CONTROL} AND {_CITR} = 0 THEN CAST(0 AS DOUBLE)"
                f" ELSE 100 + {_CITR} * CAST(50 AS DOUBLE) END"
            ),
            "NaH_ratio": _UNLESS_REF.format(f"CAST(0.25 AS DOUBLE) * (1 + {_NAH})"),
            "N3_ratio": _UNLESS_REF.format(
                f"CASE WHEN {_CONTROL} AND {_AZIDE} = 0 THEN CAST(0 AS DOUBLE)"
                f" ELSE 5 + {_AZIDE} * CAST(2.5 AS DOUBLE) END"
            ),
        },
    ),
    "wells": (
        "nation",
        {
            "cell": f"concat('A', lpad(CAST({_N} + 1 AS VARCHAR(4)), 2, '0'))",
            "type": f"CASE WHEN {_N} = 0 THEN 'ref' ELSE 'au' END",
            "conc": f"{_N} * CAST(0.5 AS DOUBLE)",
        },
    ),
    # A factorial experiment with one run per order line.
    "runs": (
        "lineitem",
        {
            "seq": "l_orderkey * 10 + l_linenumber",
            "grp": "l_returnflag",
            "quantity": "l_quantity",
            "discount": "l_discount",
            "tax": "l_tax",
            "price": "l_extendedprice / 10000",
            "a": "(l_quantity - CAST(25.5 AS DOUBLE)) / CAST(24.5 AS DOUBLE)",
            "b": "(l_discount - CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)",
            "c": "(l_tax - CAST(0.04 AS DOUBLE)) / CAST(0.04 AS DOUBLE)",
            "y": "l_extendedprice / 10000 + l_quantity * l_discount - 3 * l_tax * l_quantity",
        },
    ),
}

FL_ORDER = ("wavelength", "seq")
AB_ORDER = ("wavelength", "o1", "o2", "o3", "o4", "o5")


class Tables:
    """The views over the parquet tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        table, columns = VIEWS[name]
        source = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return source.selectExpr(*[f"{expr} AS `{c}`" for c, expr in columns.items()])


def view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    picked = ", ".join(f'{expr} AS "{c}"' for c, expr in columns.items())
    return f"SELECT {picked} FROM {table}"
