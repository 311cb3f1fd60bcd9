"""String rules (section J): species sets, functional types, grades and codes as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = ("", "nan", "none", "n/a")


def value_text(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def code_text(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def is_empty(c: Column) -> Column:
    return value_text(c).isin(*EMPTY)


def word_hits(c: Column, names: list[str]) -> Column:
    """The names that occur as whole words."""
    text = value_text(c)
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\b{n}\b"), F.lit(n)) for n in names]))


def substring_hits(c: Column, names: list[str]) -> Column:
    """The names that occur anywhere."""
    text = value_text(c)
    return F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in names]))


def is_birch(text: Column, code: Column, codes: tuple[str, ...] = ("BI", "PBI", "SBI", "XBI"), word: str = "birch") -> Column:
    """A birch code, or the word."""
    return code_text(code).isin(*codes) | value_text(text).rlike(rf"\b{word}\b")


def is_downy(text: Column, code: Column | None = None, codes: tuple[str, ...] = ("PBI",), phrase: str = "downy birch") -> Column:
    """The downy birch's code, or its name as a phrase."""
    named = value_text(text).rlike(r"\b" + phrase.replace(" ", r"\s+") + r"\b")
    return named if code is None else code_text(code).isin(*codes) | named


def only_allowed(c: Column, allowed: list[str], known: list[str], birch: Column | None = None, downy: Column | None = None) -> Column:
    """Empty: true; a birch: whether it is a downy one; no known species: false; else whether all hits are allowed."""
    hits = word_hits(c, known)
    out = F.when(is_empty(c), True)
    if birch is not None:
        out = out.when(birch, F.coalesce(downy, F.lit(False)) if downy is not None else F.lit(False))
    return out.when(F.size(hits) == 0, False).otherwise(F.size(F.array_except(hits, F.array(*map(F.lit, allowed)))) == 0)


def off_peat(primary: Column, others: list[Column], target: list[str], alder: str, birch: str, exclude_birch: bool = False, downy: Column | None = None) -> Column:
    """The primary species is a target one or a downy birch, alder is anywhere, and, if asked, there is no birch."""
    every = [primary, *others]
    has = lambda n: F.greatest(*[F.size(word_hits(c, [n])) for c in every]) > 0 if len(every) > 1 else F.size(word_hits(primary, [n])) > 0
    first = F.size(word_hits(primary, target)) > 0
    out = (first if downy is None else first | downy) & has(alder)
    return out & ~has(birch) if exclude_birch else out


def on_peat(primary: Column, others: list[Column], target: list[str], known: list[str], downy: Column | None = None, birches: list[tuple[Column, Column]] | None = None) -> Column:
    """The primary species is a target one or a downy birch, and all others are empty or allowed; `birches` has (is birch, is downy) of each of the others."""
    out = F.size(word_hits(primary, target)) > 0
    out = out if downy is None else out | downy
    for i, c in enumerate(others):
        out = out & only_allowed(c, target, known, *(birches[i] if birches else ()))
    return out


def functional_type(columns: list[Column], deciduous: list[str], evergreen: list[str]) -> Column:
    """0 mixed or unknown, 1 deciduous only, 2 evergreen only."""
    d = sum((F.size(substring_hits(c, deciduous)) for c in columns[1:]), F.size(substring_hits(columns[0], deciduous)))
    e = sum((F.size(substring_hits(c, evergreen)) for c in columns[1:]), F.size(substring_hits(columns[0], evergreen)))
    return F.when((d > 0) & (e == 0), 1).when((e > 0) & (d == 0), 2).otherwise(0)


def dry_type(primary: Column, others: list[Column], deciduous: list[str], evergreen: list[str], hints: tuple[list[str], list[str]] | None = None) -> Column:
    """1 deciduous, 0 evergreen: more hits win; a tie goes by the primary species, then by general words (`hints`: of deciduous, of evergreen) in any column; else 1."""
    n = lambda names: sum((F.size(substring_hits(c, names)) for c in others), F.size(substring_hits(primary, names)))
    d, e = n(deciduous), n(evergreen)
    pd, pe = F.size(substring_hits(primary, deciduous)), F.size(substring_hits(primary, evergreen))
    out = F.when(d > e, 1).when(e > d, 0).when(pe > pd, 0)
    if hints:
        out = out.when(pd > pe, 1).when(n(hints[0]) > 0, 1).when(n(hints[1]) > 0, 0)
    return out.otherwise(1)


def species_filter(columns: list[Column], target: list[str]) -> Column:
    """All columns hold a target species or are empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (is_empty(c) | (F.size(word_hits(c, target)) > 0))
    return out


def species_column(df: DataFrame, candidates: list[str], names: list[str]) -> str | None:
    """The first candidate column with a hit, else the first string column with one (J10). One scan."""
    strings = [c for c, t in df.dtypes if t == "string"]
    order = [c for c in candidates if c in strings] + [c for c in strings if c not in candidates]
    if not order:
        return None
    row = df.agg(*[F.max(F.size(word_hits(F.col(c), names)) > 0).alias(c) for c in order]).first()
    return next((c for c in order if row[c]), None)


#: Names of classes by schema.
SCHEMAS = {
    "binary_01": {0: "background", 1: "wet"},
    "legacy_012": {0: "evergreen", 1: "deciduous", 2: "wet"},
    "split_bg_0123": {0: "evergreen", 1: "deciduous", 2: "wet_on_peat", 3: "wet_off_peat"},
}


def run_id(name: Column, number: Column) -> Column:
    """A run's name with its number behind it, if it doesn't end in it yet; without a name, run_<number>; paths lose a closing slash."""
    base = F.regexp_replace(F.trim(name), r"[/\\\\]+$", "")
    end = F.concat(F.lit("_"), number.cast("string"))
    return F.when(F.coalesce(base, F.lit("")) == "", F.concat(F.lit("run"), end)).when(base.endswith(end), base).otherwise(F.concat(base, end))


def feature_names(width: int) -> list[str]:
    """Names of feature bands by their number: 64 embeddings, then elevation and slope, aspect, a wetness index; other widths count up (D-25)."""
    more = ["elevation", "slope", "aspect", "twi"][: width - 64] if width in (66, 67, 68) else []
    return [f"emb_{i:02d}" for i in range(64)] + more if more else [f"band_{i}" for i in range(width)]


def class_name(label: Column, names: dict[int, str]) -> Column:
    """J11."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[label]


def grade_group(c: Column) -> Column:
    """Agricultural land grades: text folded; non-agricultural is 4-6; urban and exclusion unknown; else by the first digit 1-5."""
    t = F.trim(F.regexp_replace(value_text(c), r"[_\-\s]+", " "))
    digit = F.regexp_extract(t, "[1-5]", 0)
    return F.when(t.isin(*EMPTY), "unknown").when(t.contains("non agricultural"), "4-6").when(t.contains("urban") | t.contains("exclusion"), "unknown").when(digit.isin("1", "2"), "1-2").when(digit == "3", "3").when(digit.isin("4", "5"), "4-6").otherwise("unknown")


def encode_type(c: Column | None, codes: dict[str, int], missing_column: int = 4) -> Column:
    """Codes by name without case; unknown 0; without the column `missing_column`."""
    if c is None:
        return F.lit(missing_column)
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k.lower(), v)])[value_text(c)], F.lit(0))


def safe_labels(df: DataFrame, name: str, order: str) -> DataFrame:
    """`safe`: other characters than letters and digits folded to _, ends stripped, repeats numbered _2, _3 ... in order."""
    base = F.regexp_replace(F.regexp_replace(F.col(name), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    turn = F.row_number().over(Window.partitionBy("__gl_b").orderBy(order))
    return df.withColumn("__gl_b", base).withColumn("__gl_k", turn).withColumn("safe", F.when(F.col("__gl_k") == 1, F.col("__gl_b")).otherwise(F.concat("__gl_b", F.lit("_"), F.col("__gl_k").cast("string")))).drop("__gl_b", "__gl_k")


def parse_list(c: Column) -> Column:
    """A comma-separated list: trimmed, without empty items, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def newest(df: DataFrame, path: str, mtime: str) -> DataFrame:
    """The path of the greatest (trailing digits, mtime, name)."""
    digits = F.coalesce(F.expr(f"try_cast(regexp_extract({path}, '(\\\\d+)\\\\D*$', 1) as bigint)"), F.lit(-1))
    return df.agg(F.max_by(path, F.struct(digits, mtime, path)).alias("path"))


def label_schema(df: DataFrame, label: str) -> DataFrame:
    """split_bg_0123 if there is a class 3, else legacy_012; and the classes that count as positive."""
    s = df.agg((F.coalesce(F.max((F.col(label) == 3).cast("int")), F.lit(0)) == 1).alias("s"))
    return s.select(F.when(F.col("s"), "split_bg_0123").otherwise("legacy_012").alias("schema"), F.when(F.col("s"), "2,3").otherwise("2").alias("positive"))


def ramp(v: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear interpolation over stops, clamped at the ends."""
    out = F.lit(stops[-1][1])
    for (a, x), (b, y) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        out = F.when(v < b, F.lit(x) + (v - a) / (b - a) * (y - x)).otherwise(out)
    return F.when(v.isNull(), None).when(v <= stops[0][0], F.lit(stops[0][1])).otherwise(out)
