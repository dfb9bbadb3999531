"""Operator 1: secret scans, in DataFrame functions only.

Base patterns give spans of three kinds. A test battery adds the kind `random`: every run of 20 or more key characters is
a candidate; the narrowest alphabet that holds it is its encoding. Under the hypothesis of random characters it must pass
a chi-squared test of uniformity (the mean and variance of the statistic are exact, so sparse cells do no harm), a runs
test about the alphabet's middle and a test of lag-1 serial correlation. Under the hypothesis of ordinary writing its
count of equal pairs and of changes between lower case, upper case and digits give a p-value, and candidates of like
length are judged together by the Benjamini-Hochberg rule over the whole table: long strings can prove more, so they do
not share a threshold with short ones. P-values are counted in steps of a quarter bit, so the rule needs some hundred rows.
A run that meets base spans is a candidate as a whole and so is what the base spans leave of it; it counts where it
reaches beyond them, and then stands for its remainders.

Nulls: a null text is empty, null ids are kept. Repeated rows stay rows. A very long text is searched whole, in time near
the number of its matches. Spans of equal start stand in the order of the kinds. An empty table gives an empty table.
Extra columns are kept by `masked`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What texts with a span of another kind than assign have; the look back leaves the insides of words quickly.
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
KEY = "[A-Za-z0-9+/_-]"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets, narrowest first, with the pattern of a string that uses it and no narrower one.
ALPHABETS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Ordinary writing: the chance that two, or three, of its letters are equal, and that a class of characters ends.
PAIR, TRIPLE, CHANGE = 0.07, 0.0075, 0.15
#: The battery's level, and the share of false discoveries among `random` spans of a length.
LEVEL, FALSE = 0.001, 0.05
#: Shortest lengths of the strata in which false discoveries are controlled.
STRATA = (20, 24, 32, 48, 80)
STEPS = 400


EMPTY = "array<struct<start:int,end:int,value:string>>"


#: Items that a running value is carried over at once, and code points of a piece that a text is cut into.
RUN, PIECE = 64, 256


def running(xs: Column, of: Callable[[Column], Column], join: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """`make(x, at)` of each item, `at` being `join` over `of` of the items before it, from 0. It runs over blocks of items and
    then inside them, so that a text with many matches costs near their number."""

    def over(items: Column, value: Callable[[Column], Column], start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    whole = lambda items: F.aggregate(items, F.lit(0), lambda acc, x: join(acc, of(x)))
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))
    placed = lambda bs: F.zip_with(bs, over(bs, lambda b: F.greatest(whole(b), F.lit(0)), F.lit(0)), lambda b, at: F.zip_with(b, over(b, of, at), make))
    return let(xs, lambda xs: F.when(F.size(xs) > 0, F.flatten(let(blocks(xs), placed))).otherwise(F.transform(xs, lambda x: make(x, F.lit(0)))))


def cut(text: Column, make: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """`make(part)`, where `part(a, b)` is the text between two places. Spark's `substring` walks from the start of a text; this
    one walks from the start of a piece of `PIECE` code points, so that many parts cost near their length."""

    def of(pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            whole = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(whole, a - first * PIECE + 1, b - a)).otherwise("")

        return make(part)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches; those with a shorter `group` are dropped after matching."""
    p = F.lit(pattern)

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["b"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.length(x["g"]).alias("n"))

    def placed(found: Column) -> Column:
        rest = F.regexp_extract_all(text, p, F.lit(group)) if group else found
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("b"), found.alias("m"), rest.alias("g"))
        at = running(parts, lambda x: F.length(x["b"]) + F.length(x["m"]), lambda a, b: a + b, place)
        kept = F.transform(F.filter(at, lambda x: x["n"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(EMPTY))

    return let(F.regexp_extract_all(text, p, F.lit(0)), placed)


def _tail(z: Column) -> Column:
    """The normal upper tail, by the Abramowitz-Stegun polynomial."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def tested(found: Column) -> Column:
    """Candidates as array<struct<start, end, p_random, step, stratum>>: the battery's p-value, the p-value as ordinary
    writing in quarter bits, and the length stratum."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    keep = lambda c: (c["start"].alias("start"), c["end"].alias("end"), c["beyond"].alias("beyond"))

    def read(c: Column) -> Column:
        s = F.regexp_replace(c["value"], "=+$", "")
        alphabet = F.coalesce(*[F.when(s.rlike(p), F.lit(a)) for _, p, a in ALPHABETS])
        return F.struct(*keep(c), alphabet.alias("alphabet"), F.regexp_extract_all(s, F.lit("."), F.lit(0)).alias("chars"), F.regexp_count(s, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")).cast("double").alias("classes"))

    def place(c: Column) -> Column:
        at = F.transform(c["chars"], lambda x: F.instr(c["alphabet"], x).cast("double"))
        return F.struct(*keep(c), F.size(c["chars"]).cast("double").alias("n"), F.length(c["alphabet"]).cast("double").alias("k"), at.alias("at"), F.array_sort(c["chars"]).alias("sorted"), c["classes"].alias("classes"))

    def measure(c: Column) -> Column:
        # equal pairs: walking the sorted characters, each adds the length of the run of equals before it
        zero = F.struct(F.lit("").alias("was"), F.lit(0.0).alias("run"), F.lit(0.0).alias("pairs"))
        walk = lambda a, x: F.struct(x.alias("was"), F.when(x == a["was"], a["run"] + 1).otherwise(F.lit(0.0)).alias("run"), (a["pairs"] + F.when(x == a["was"], a["run"] + 1).otherwise(F.lit(0.0))).alias("pairs"))
        pairs = F.aggregate(c["sorted"], zero, walk)["pairs"]
        side = F.transform(c["at"], lambda x: F.when(x * 2 > c["k"], F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.struct(*keep(c), c["n"].alias("n"), c["k"].alias("k"), c["classes"].alias("classes"), pairs.alias("pairs"), (total(c["at"]) / c["n"]).alias("mean"), c["at"].alias("at"), side.alias("side"))

    def follow(c: Column) -> Column:
        first = lambda xs: F.slice(xs, F.lit(1), F.size(xs) - 1)
        later = lambda xs: F.slice(xs, F.lit(2), F.size(xs) - 1)
        product = total(F.zip_with(first(c["at"]), later(c["at"]), lambda a, b: (a - c["mean"]) * (b - c["mean"])))
        square = total(F.transform(c["at"], lambda x: (x - c["mean"]) * (x - c["mean"])))
        runs = 1 + total(F.zip_with(first(c["side"]), later(c["side"]), lambda a, b: F.abs(a - b)))
        own = [c[x].alias(x) for x in ("n", "k", "classes", "pairs")]
        return F.struct(*keep(c), *own, runs.alias("runs"), total(c["side"]).alias("high"), F.when(square > 0, product / square).otherwise(F.lit(1.0)).alias("serial"))

    def judge(c: Column) -> Column:
        n, k = c["n"], c["k"]
        both, three = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
        # random: pairs are k/n of the chi-squared statistic; runs by Wald and Wolfowitz; serial correlation has variance 1/n
        uniform = (c["pairs"] - both / k) / F.sqrt(both / k * (1 - 1 / k))
        low = n - c["high"]
        expected = 1 + 2 * c["high"] * low / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((c["high"] == 0) | (low == 0), F.lit(9.0)).otherwise((c["runs"] - expected) / spread)
        serial = (c["serial"] + 1 / n) * F.sqrt(n)
        p_random = F.least(F.lit(1.0), 3 * F.least(_tail(uniform), 2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial))))
        # ordinary writing: few equal pairs, or many changes of class (Chernoff's bound), joined by Fisher's rule
        p_pairs = 1 - _tail((c["pairs"] - both * PAIR) / F.sqrt(both * (PAIR - PAIR**2) + 6 * three * (TRIPLE - PAIR**2)))
        share = F.greatest(F.lit(CHANGE), F.least(F.lit(0.999), (c["classes"] - 1) / (n - 1)))
        log_classes = -(n - 1) * (share * F.log(share / CHANGE) + (1 - share) * F.log((1 - share) / (1 - CHANGE)))
        half = -(F.log(F.greatest(p_pairs, F.lit(1e-30))) + log_classes)
        bits = (half - F.log1p(half)) / F.log(F.lit(2.0))
        stratum = F.lit(0)
        for i, least in enumerate(STRATA):
            stratum = F.when(n >= least, F.lit(i)).otherwise(stratum)
        step = F.least(F.lit(STEPS), F.floor(bits * 4).cast("int"))
        return F.struct(*keep(c), p_random.alias("p_random"), step.alias("step"), stratum.alias("stratum"))

    for part in (read, place, measure, follow, judge):
        found = F.transform(found, part)
    return found


def plain(xs: Column, kind: int) -> Column:
    return F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def covered(xs: Column, make: Callable[[Column, Column], Column]) -> Column:
    """`make(x, at)` of spans in order, `at` being where the spans before it end."""
    return running(xs, lambda x: x["end"], F.greatest, make)


def replaced(text: Column, xs: Column, make: Callable[[Column, Column], Column]) -> Column:
    """The text with `make(x, at)` in place of what each span covers beyond `at`, the end of those before it."""

    def of(part: Callable[[Column, Column], Column]) -> Column:
        pieces = covered(xs, lambda x, at: F.concat(part(at, x["start"]), make(x, at)))
        end = F.aggregate(xs, F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
        return F.concat(F.array_join(pieces, ""), let(end, lambda end: part(end, F.length(text))))

    return F.when(F.size(xs) > 0, cut(text, of)).otherwise(text)


def blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans, so that places stay."""
    return replaced(text, base, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(at, x["start"]), F.lit(0))))


def tested_rows(docs: DataFrame, text_col: str, base: str, found: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with base spans and tested candidates, written and read back: texts are searched once.

    A text without a run of 20 key characters has spans of the kind assign alone, and none of them without `:` or `=`."""
    long, set_, blank = (free_name(docs, x) for x in ("secret_long", "secret_set", "secret_blank"))
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(EMPTY)
    rows = docs.withColumn(long, text.rlike(LONG)).withColumn(set_, (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN))
    assign = plain(F.when(F.col(set_), spans(text, ASSIGN, 2, 6)).otherwise(none), 0)
    others = [plain(F.when(F.col(long), spans(text, p)).otherwise(none), k) for k, p in ((1, ACCESS), (2, HEX))]
    rows = rows.withColumn(base, F.array_sort(F.concat(assign, *others)))
    rows = rows.withColumn(blank, blanked(text, F.col(base)))
    # runs of the text, and what base spans leave of them; without base spans both are the same
    left = F.when(F.col(long), spans(F.col(blank), CANDIDATE)).otherwise(none)
    runs = F.when(F.col(long) & (F.size(base) > 0), spans(text, CANDIDATE)).otherwise(none)

    def beyond(part: Callable[[Column, Column], Column]) -> Column:  # what is left of each run, which differs where it met a span
        seen = F.transform(F.col(found), lambda x: F.struct(*[x[f].alias(f) for f in ("start", "end", "value", "run")], part(x["start"], x["end"]).alias("own")))
        new = F.filter(seen, lambda x: ~x["run"] | (x["own"] != x["value"]))
        return F.transform(new, lambda x: F.struct(*[x[f].alias(f) for f in ("start", "end", "value")], x["own"].rlike(KEY).alias("beyond")))

    marked = lambda xs, run: F.transform(xs, lambda x: F.struct(*[x[f].alias(f) for f in ("start", "end", "value")], F.lit(run).alias("run")))
    rows = rows.withColumn(found, F.concat(marked(left, False), marked(runs, True)))
    rows = rows.withColumn(found, F.when(F.size(found) > 0, cut(F.col(blank), beyond)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,beyond:boolean>>")))
    return materialize(rows.withColumn(found, tested(F.col(found))).select(*keep, base, found), "secrets")


def thresholds(found: DataFrame, column: str, false: float = FALSE) -> dict[int, int]:
    """For each stratum, the least step at which the share of false discoveries stays under `false` (at most 5 rows)."""
    counts = found.select(F.explode(column).alias("c")).groupBy("c.stratum", "c.step").agg(F.count("*").alias("n"))
    out: dict[int, int] = {}
    total: dict[int, int] = {}
    rows = sorted(((r.stratum, r.step, r.n) for r in counts.collect()), reverse=True)  # strata times steps, 2,005 rows at most
    for stratum, _, n in rows:
        total[stratum] = total.get(stratum, 0) + n
    reached: dict[int, int] = {}
    for stratum, step, n in rows:
        reached[stratum] = reached.get(stratum, 0) + n
        if 2.0 ** (-step / 4) * total[stratum] <= false * reached[stratum]:
            out[stratum] = step
    return out


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"),
        (F.size("secret_spans") - F.size("secret_base")).cast("long").alias("n_random"),
    )


def written(xs: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str = "text", base_name: str = "secret_base", all_name: str = "secret_spans", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) with their base spans and all spans; a random span is there where base
    spans do not cover its characters."""
    rows = tested_rows(docs, text_col, base_name, all_name, docs.columns if keep is None else keep)
    limits = thresholds(rows, all_name)

    def sure(c: Column) -> Column:
        ok = F.lit(False)
        for stratum, step in limits.items():
            ok = ok | ((c["stratum"] == stratum) & (c["step"] >= step))
        return ok & (c["p_random"] >= LEVEL) & c["beyond"]

    # outermost spans alone: in order of start, longer ones first, one that ends inside those before it is within one of them
    sure_ones = F.transform(F.filter(F.col(all_name), sure), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["end"].alias("end")))
    ends = covered(F.array_sort(sure_ones), lambda x, at: F.struct(x["start"].alias("start"), x["end"].alias("end"), at.alias("at")))
    outer = plain(F.filter(ends, lambda x: x["end"] > x["at"]), 3)
    return rows.withColumn(all_name, F.array_sort(F.concat(F.col(base_name), outer)))


def masked(docs: DataFrame, text_col: str = "text", count_col: str | None = None, mask: str = "[masked]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mask`; `count_col` gets the new number of code points."""
    base, spanned = free_name(docs, "secret_base"), free_name(docs, "secret_spans")
    rows = with_spans(docs, text_col, base, spanned)
    text = F.col(text_col)
    new = replaced(text, F.col(spanned), lambda x, at: F.when(x["start"] >= at, F.lit(mask)).otherwise(""))  # overlapping spans share one
    out = rows.withColumn(text_col, new)
    if count_col:
        out = out.withColumn(count_col, F.when(F.size(spanned) > 0, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return out.select(*docs.columns)
