"""How queries are registered, and SQL that fits by another algorithm.

The oracles fit by Gram-Schmidt over columns, in SQL: independent of the moment
sums and QR of the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


UNIT = "2 * (x - lo) / (hi - lo) - 1"
ANGLE = "2 * pi() * (x - lo) / (hi - lo)"
LOG = "ln(x - lo + 1)"


def rows_sql(source: str, x: str, y: str, keys: Sequence[str] = (), t: str = UNIT) -> str:
    """keys, x, y, t of a table."""
    cols = "".join(f"{k}, " for k in keys)
    return f"select d.*, {t} as t, lo, hi from (select {cols}({x})::double as x, ({y})::double as y from {source}) d, (select min(({x})::double) as lo, max(({x})::double) as hi from {source})"


def fit_sql(rows: str, columns: Sequence[str]) -> str:
    """CTEs that end in f: the rows with q0.. (orthogonal columns), c0.. (their
    coefficients), and fit0.. (the fit by the first columns only)."""
    out = []
    for j, col in enumerate(columns):
        if j == 0:
            out.append(f"g0 as (select *, ({col})::double as q0 from ({rows}))")
        else:
            before = range(j)
            out.append(f"u{j} as (select *, ({col})::double as u from g{j - 1})")
            out.append(f"w{j} as (select {', '.join(f'sum(u * q{i}) / sum(q{i} * q{i}) as w{j}_{i}' for i in before)} from u{j})")
            out.append(f"g{j} as (select u{j}.* exclude (u), u - {' - '.join(f'w{j}_{i} * q{i}' for i in before)} as q{j} from u{j}, w{j})")
        out.append(f"k{j} as (select sum(y * q{j}) / sum(q{j} * q{j}) as c{j} from g{j})")
    last = len(columns) - 1
    fits = [" + ".join(f"c{i} * q{i}" for i in range(j + 1)) + f" as fit{j}" for j in range(last + 1)]
    out.append(f"f as (select *, {', '.join(fits)} from g{last}, {', '.join(f'k{j}' for j in range(last + 1))})")
    return "with " + ",\n".join(out)


def weighted_fit_sql(rows: str, columns: Sequence[str]) -> str:
    """CTEs that end in f: rows(k, x, y, t, w, ...) with q0.. (columns made orthogonal
    under the weights w within each k), d0.. (their weighted squares), c0.. and fit0..;
    rows of weight 0 are fitted but teach nothing."""
    out = [f"g0 as (select *, ({columns[0]})::double as q0 from ({rows}))", "h0 as (select *, sum(w * q0 * q0) over (partition by k) as d0 from g0)"]
    for j, col in enumerate(columns[1:], 1):
        out.append(f"u{j} as (select *, ({col})::double as u from h{j - 1})")
        less = " - ".join(f"sum(w * u * q{i}) over (partition by k) / d{i} * q{i}" for i in range(j))
        out.append(f"g{j} as (select * exclude (u), u - {less} as q{j} from u{j})")
        out.append(f"h{j} as (select *, sum(w * q{j} * q{j}) over (partition by k) as d{j} from g{j})")
    last = len(columns) - 1
    out.append("v as (select *, " + ", ".join(f"sum(w * y * q{j}) over (partition by k) / d{j} as c{j}" for j in range(last + 1)) + f" from h{last})")
    fits = [" + ".join(f"c{i} * q{i}" for i in range(j + 1)) + f" as fit{j}" for j in range(last + 1)]
    out.append(f"f as (select *, {', '.join(fits)} from v)")
    return "with " + ",\n".join(out)


def powers(degree: int, of: str = "t") -> list[str]:
    return ["1"] + [f"pow({of}, {p})" for p in range(1, degree + 1)]


def waves(degree: int, of: str = "t") -> list[str]:
    return ["1"] + [f"{w}({h} * {of})" for h in range(1, degree + 1) for w in ("sin", "cos")]
