"""Secret scans, with DataFrame and SQL functions only.

Three patterns find assignments, access keys and hexadecimal runs. Longer tokens outside those spans are judged by two
character Markov models, of random strings and of ordinary identifiers: the sum of the log-likelihood ratios of the
characters, each given the one before it, must pass a threshold in some stretch of the token, so that a name or path
glued to a key doesn't cancel it. A plain word or number is judged by the sum over all of it, and a token of 12 to 19
characters only if it has a digit and four letters, as prose has many odd words of that length. The models are counted in Spark from labelled
samples; their table has one entry for each pair of characters, whatever the number of samples.

Positions are found without a user function: the texts between matches and the matches alternate, so running sums of
their lengths, in code points, place every match.

Defined results: a null or empty text has no spans; texts have no length limit; repeated rows get equal results; null
ids are kept; other columns are left out; an empty table gives an empty one; without samples every ratio is zero and
nothing is added to the patterns' spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns, the shortest match or group that each keeps, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
LEAST_GROUP, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 6, 20, 24, 20
# Words of ordinary identifiers.
ORDINARY = (
    "account address amount array average balance batch before billing block border branch buffer button cache call category center change channel check child "
    "client close cluster code column commit config connect content context control count country create currency current customer data date default delete "
    "detail device document domain driver element email enable engine entry error event export factory field file filter folder format function gateway global "
    "group handler header height history image import index input instance integer interface internal invoice item iterator job key label language layer "
    "length level library limit line list loader local location log manager map master member memory message method model module month name network node "
    "number object offset option order output owner package page parameter parent partition path payment period policy position process product profile "
    "Abteilung Anfrage Beschreibung Einstellung Entwicklung Geschwindigkeit Gesellschaft Verantwortung anteriormente construcción desarrollo información "
    "appartement connaissance développement gouvernement naturellement"
).split()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Shortest token that is judged at all, and what one below ``LEAST_RANDOM`` must have.
LEAST_SHORT = 12
_SIGN = "[A-Za-z0-9+/_=-]"
#: A whole run of a token's signs, long or with a digit; looked at once, where it starts.
TOKEN = f"(?<!{_SIGN})(?={_SIGN}{{{LEAST_RANDOM}}}|{_SIGN}*[0-9]){_SIGN}{{{LEAST_SHORT},}}"
SHORT = r"^(?=.*[0-9])(?:[^A-Za-z]*[A-Za-z]){4}"
PLAIN = r"^([A-Z]?[a-z]+|[0-9]+)$"
#: Log-likelihood ratio above which a token counts as random: the prior odds against it.
THRESHOLD = 10.0
#: Matches that one step of a running sum takes, so that long lists cost in proportion.
CHUNK = 256

_SPANS = "array<struct<start:int,stop:int>>"


def default_samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """``sample, random``: strings made from hash digests, and identifiers made from words, in several styles."""
    n = spark.range(each)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    size = (20 + F.col("id") % 21).cast("int")
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "[=]", "")
    style = F.col("id") % 4
    random = F.when(style == 0, F.substring(digest, F.lit(1), size)).when(style == 1, F.upper(F.substring(digest, F.lit(1), size))).when(style == 2, F.substring(coded, F.lit(1), size)).otherwise(F.substring(F.regexp_replace(coded, "[+/]", ""), F.lit(1), size))
    words = F.split(F.lit(" ".join(ORDINARY)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    three = [pick(k) for k in range(3)]
    shape = F.col("id") % 6
    ordinary = (
        F.when(shape == 0, F.concat_ws("_", *three)).when(shape == 1, F.concat(F.lower(three[0]), F.initcap(three[1]), F.initcap(three[2]))).when(shape == 2, F.upper(F.concat_ws("_", *three)))
        .when(shape == 3, F.concat_ws("-", *three, (F.col("id") % 100).cast("string"))).when(shape == 4, F.lower(F.concat(*three))).otherwise(F.concat(F.concat_ws("/", *three), F.lit("."), (F.col("id") % 10).cast("string")))
    )
    return n.select(random.alias("sample"), F.lit(True).alias("random")).unionByName(n.select(ordinary.alias("sample"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log ratio of each character after each other one, or at the start, row by row; add-one smoothed."""
    marks = F.transform(F.split(F.regexp_replace("sample", r"[^A-Za-z0-9+/_.=-]", ""), ""), lambda c: F.when(c != "", F.position(c, F.lit(ALPHABET))).otherwise(F.lit(0)))
    lists = samples.filter("sample is not null and random is not null").select("random", F.filter(marks, lambda x: x > 0).alias("m")).filter("size(m) > 0")
    pairs = lists.select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("m", F.lit(1), F.size("m") - 1)).alias("a"), F.col("m").alias("b"))).alias("p"))
    n = len(ALPHABET)
    counts = {True: [[1] * n for _ in range(n + 1)], False: [[1] * n for _ in range(n + 1)]}
    for r in pairs.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect():  # a bounded table
        counts[r["random"]][r["a"]][r["b"] - 1] += r["count"]
    return [math.log(x / sum(p)) - math.log(y / sum(q)) for p, q in zip(counts[True], counts[False]) for x, y in zip(p, q)]


def _summed(token: str | Column, table: list[float], restart: bool) -> Column:
    lookup = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("most"), F.lit(0).alias("p"))

    def step(acc: Column, c: Column) -> Column:
        place = F.position(c, F.lit(ALPHABET))
        before = F.greatest(acc["s"], F.lit(0.0)) if restart else acc["s"]
        s = before + F.element_at(lookup, acc["p"] * len(ALPHABET) + place)
        return F.struct(s.alias("s"), F.greatest(acc["most"], s).alias("most"), place.alias("p"))

    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step, lambda acc: acc["most" if restart else "s"])


def ratio(token: str | Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token of ``ALPHABET``'s characters."""
    return _summed(token, table, False)


def best_ratio(token: str | Column, table: list[float]) -> Column:
    """The largest log-likelihood ratio of any stretch of the token."""
    return _summed(token, table, True)


def is_random(token: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    some = best_ratio(token, table) > threshold
    return F.when(F.char_length(token) < LEAST_RANDOM, token.rlike(SHORT) & some).when(token.rlike(PLAIN), ratio(token, table) > threshold).otherwise(some)


def matches(text: str, pattern: str, keep) -> Column:
    """The text before each of the leftmost non-overlapping matches, and the match, by their lengths, with ``keep(match)``.

    One entry more than there are matches: the last has the text behind them and neither size nor keep.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), (m.isNotNull() & keep(m)).alias("keep")))
    return F.when(F.col(text).rlike(pattern), steps)


def placed(steps: str) -> Column:
    """The spans of the ``matches`` that are kept."""

    def inner(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + s["size"]
        return F.struct(end.alias("at"), F.when(s["keep"], F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("stop")))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)

    def outer(acc: Column, chunk: Column) -> Column:
        one = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return F.struct(one["at"].alias("at"), F.array_append(acc["out"], one["out"]).alias("out"))

    cut = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, F.lit(CHUNK)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    return F.when(F.col(steps).isNotNull(), F.flatten(F.aggregate(cut, zero, outer, lambda acc: acc["out"]))).otherwise(none)


def _marked(spans: str, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))


def _written_out(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scanned(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column ``scan`` of ``assign``, ``access``, ``hex`` and ``random`` spans and ``base`` and ``all``
    lists of start, rank of kind and stop, in order. One pass, no shuffle. ``docs`` has ``text``, never null."""
    table = train(default_samples(docs.sparkSession)) if table is None else table
    group = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2))
    # columns of their own, read several times below, so that each pattern is matched once
    met = docs.select(
        "*",
        matches("text", ASSIGN, lambda m: group(m) >= LEAST_GROUP).alias("assign"),
        matches("text", ACCESS, lambda m: F.char_length(m) >= LEAST_ACCESS).alias("access"),
        # a whole run is one match, so runs that are too short can be passed over at once
        matches("text", f"(?<!{HEX[:-1]}){HEX[:-1]}{{{LEAST_HEX},}}", lambda m: F.lit(True)).alias("hex"),
        matches("text", TOKEN, lambda m: is_random(m, table, threshold)).alias("token"),
    )
    found = met.select(*docs.columns, F.struct(*[placed(k).alias(k) for k in ("assign", "access", "hex", "token")]).alias("scan"))
    base = F.array_sort(F.concat(*[_marked(f"scan.{k}", k) for k in KINDS[:3]]))
    apart = F.filter("scan.token", lambda t: ~F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    sorted_ = found.withColumn("base", base).withColumn("random", apart)
    return sorted_.withColumn("all", F.when(F.size("random") > 0, F.array_sort(F.concat("base", _marked("random", "random")))).otherwise(F.col("base")))


def secrets(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """The contract's columns and ``n_random`` of every row."""
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    count = lambda c: F.size(c).cast("long")
    return scanned(columns, table).select(
        "doc_id", count("scan.assign").alias("n_assign"), count("scan.access").alias("n_access"), count("scan.hex").alias("n_hex"),
        F.sha2(_written_out("base"), 256).alias("base_sha256"), _written_out("all").alias("spans"), count("random").alias("n_random"),
    )


def redacted(text: str, spans: str, by: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``by``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when((s["start"] >= acc["at"]), F.array_append(acc["kept"], gap)).otherwise(acc["kept"]).alias("kept"))

    rest = lambda acc: F.concat(F.array_join(F.array_append(acc["kept"], F.lit("")), by), F.substring(F.col(text), acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), zero, step, rest)).otherwise(F.col(text))


def without_secrets(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced; ``n_chars``, if there, counts the new text's."""
    # names of their own, as the documents may have columns of any name
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clean = scanned(rows, table).select("row", F.when(F.col("row.text").isNotNull(), redacted("text", "all")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.char_length(F.coalesce("clean", F.lit(""))).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return clean.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
