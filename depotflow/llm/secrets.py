"""Secret scan with corpus-wide ownership frequency, in column expressions only."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from .common import text_of, write_shared


@dataclass(frozen=True)
class Ownership:
    """How often a value may occur and still look like somebody's own credential."""

    max_owners: int = 1
    max_repositories: int = 2
    min_distinct_chars: int = 10
    example_owners: int = 3      # from so many owners on a value is a copied example


#: kind, pattern, group that holds the value, least length of the value. The order breaks ties.
BASE_KINDS = (
    ("assign", "(?=[PpSsTtAa])([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
               "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
#: What the method may add: long tokens that mix letters and digits.
LOOSE_KIND = ("owned", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)


SPANS = "array<struct<start:bigint,number:int,kind:string,end:bigint,value:string>>"


def _let(value, use):
    """`use(value)` with the value computed once; a lambda would compute a plain expression for each element."""
    return F.transform(F.array(value), use)[0]


def _groups(size, length):
    """First places, counted from 1, of groups of `length` among `size` elements; `size` is 1 or more."""
    return F.sequence(F.lit(1), size, length)


def _running(values, combine, zero):
    """For each element of a not empty long array, all elements before it folded by `combine` from `zero`.

    An appending fold copies what it has for each element. Here groups of (2n)^(1/3) elements are folded
    apart and the groups' totals are folded once, so n elements take n^(4/3) copies and not n^2.
    """
    def appended(values, begin):
        start = F.struct(begin.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(values, start, lambda s, v: F.struct(
            combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def fold(x):
        total = lambda at: F.aggregate(F.slice(x["values"], at, x["length"]), F.lit(zero).cast("long"), lambda a, b: combine(a, b))
        starts = _groups(F.size(x["values"]), x["length"])
        begins = appended(F.transform(starts, total), F.lit(zero).cast("long"))
        return _let(begins, lambda begin: F.flatten(F.transform(
            starts, lambda at, k: appended(F.slice(x["values"], at, x["length"]), F.element_at(begin, k + 1)))))

    return _let(values, lambda v: _let(F.struct(
        v.alias("values"), F.ceil(F.cbrt(2 * F.size(v))).cast("int").alias("length")), fold))


def _spans(text, number, kind, pattern, group, least):
    """Array of spans of one kind: start, number, kind, end, value.

    The texts between the matches give the starts. They are cut only in rows that match.
    """
    def placed(x):
        sizes = F.zip_with(x["gaps"], x["found"], lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        return _let(F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), _running(
            sizes, lambda a, b: a + b, 0).alias("at")), lambda y: F.transform(y["found"], lambda m, i: span(y, m, i)))

    def span(y, match, i):
        begin = F.element_at(y["at"], i + 1) + F.length(F.element_at(y["gaps"], i + 1))
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(begin.cast("long").alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"),
                        (begin + F.length(match)).cast("long").alias("end"), value.alias("value"))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    long = F.filter(_let(found, placed), lambda s: F.length(s["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), long).otherwise(F.expr(f"cast(array() as {SPANS})"))


_FAR = (1 << 62)


def _apart(base, loose):
    """Spans of `loose` that no span of `base` overlaps, by one pass over both in order from each side."""
    kinds = len(BASE_KINDS)

    def judged(spans):
        ends = F.transform(spans, lambda s: F.when(s["number"] < kinds, s["end"]).otherwise(F.lit(0).cast("long")))
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["number"] < kinds, s["start"]).otherwise(F.lit(_FAR).cast("long")))
        sides = F.struct(spans.alias("spans"), _running(ends, F.greatest, 0).alias("left"),
                         F.reverse(_running(starts, F.least, _FAR)).alias("right"))
        return _let(sides, lambda x: F.filter(x["spans"], lambda s, i: (s["number"] >= kinds)
                    & (F.element_at(x["left"], i + 1) <= s["start"]) & (F.element_at(x["right"], i + 1) >= s["end"])))

    both = (F.size(base) > 0) & (F.size(loose) > 0)
    return F.when(both, _let(F.array_sort(F.concat(base, loose)), judged)).otherwise(loose)


def _joined(spans):
    """kind:start:end of spans in order, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_spans(docs, text="text", owner=("source",), repository=("source", "lang"),
               limits=Ownership(), carry=None):
    """`doc` (a struct of the columns `carry`, default all), `base` and `all` spans, and ownership counts.

    Every whole text is searched for the base kinds and for loose tokens.
    Values are hashed and counted over the corpus by distinct owner and distinct
    repository. Loose tokens become spans of kind `owned` only if their value
    belongs to few enough owners and repositories and does not overlap a base
    span; base spans always stay. `n_live` counts spans with such a value,
    `n_example` those whose value at least `example_owners` owners share.

    Null text is empty; a null owner or repository counts as one owner without a
    name; repeated rows each get a row; an empty table gives no rows. What the
    texts hold is written to the shared folder once, so patterns run once.
    Values are counted in the map tasks before any shuffle, and a value that very
    many rows share meets one row when its counts are joined.
    """
    none = F.expr(f"cast(array() as {SPANS})")
    source = docs.select(
        F.struct(*[F.col(c) for c in carry or docs.columns]).alias("doc"), text_of(text).alias("body"),
        F.struct(*[F.col(c).cast("string").alias(f"o{i}") for i, c in enumerate(owner)]).alias("owner"),
        F.struct(*[F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repository)]).alias("repo"))
    base = F.concat(*[_spans(F.col("body"), n, *kind) for n, kind in enumerate(BASE_KINDS)])
    found = source.select(
        "doc", "owner", "repo", base.alias("base"),
        _spans(F.col("body"), len(BASE_KINDS), *LOOSE_KIND).alias("loose"))
    mixed = F.filter("loose", lambda s: F.regexp_like(s["value"], F.lit("[0-9]"))
                     & F.regexp_like(s["value"], F.lit("[A-Za-z]")))
    apart = _apart(F.col("base"), F.col("loose"))
    found = write_shared(found.withColumn("loose", mixed).withColumn("loose", apart).withColumn(
        "row", F.monotonically_increasing_id()), "secrets")

    spans = found.select("row", "owner", "repo", F.explode(F.concat("base", "loose")).alias("s")) \
        .withColumn("hash", F.sha2(F.col("s.value"), 256))
    owners = spans.groupBy("hash", "owner", "repo").count() \
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories")) \
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    varied = F.size(F.array_distinct(F.split(F.col("s.value"), ""))) >= limits.min_distinct_chars
    live = (F.col("owners") <= limits.max_owners) & (F.col("repositories") <= limits.max_repositories) & varied
    judged = spans.join(owners, "hash").select(
        "row", "s", "owners", live.alias("live"), (F.col("owners") >= limits.example_owners).alias("example"))
    judged = judged.where(F.col("live") | (F.col("s.number") < len(BASE_KINDS))).groupBy("row").agg(
        F.collect_list("s").alias("all"), F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"), F.max("owners").alias("most_owners"))

    zero, some = F.lit(0).cast("long"), (F.size("base") > 0) | (F.size("loose") > 0)
    quiet = found.where(~some).select(
        "doc", "base", none.alias("all"), zero.alias("n_live"), zero.alias("n_example"), zero.alias("most_owners"))
    loud = found.where(some).join(judged, "row", "left").select(
        "doc", "base", F.coalesce("all", none).alias("all"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_owners")])
    return quiet.unionAll(loud)


def scan_secrets(docs, id="doc_id", **options):
    """One row per input row: `id`, counts by base kind, digest and list of spans, ownership counts.

    Spans are written kind:start:end in code points, ordered by start, then kind. See `find_spans`.
    """
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find_spans(docs, carry=[id], **options).select(
        F.col(f"doc.{id}").alias(id), *[count(k[0]).alias(f"n_{k[0]}") for k in BASE_KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        "n_live", "n_example", "most_owners")


def _masked(body, spans, mask):
    """`body` with each run of overlapping `spans` (in order, one or more) replaced by `mask`.

    A substring is found by counting from the start of its text. So the texts before the masks are cut
    from pieces of the body that hold the square root of their number each.
    """
    def kept(spans):
        reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
        cuts = _let(reach, lambda at: F.filter(F.transform(spans, lambda s, i: F.struct(
            F.element_at(at, i + 1).cast("int").alias("begin"), s["start"].cast("int").alias("end"))), lambda c: c["begin"] <= c["end"]))
        last = F.array_max(F.transform(spans, lambda s: s["end"])).cast("int")
        tail = F.substring(body, last + 1, F.length(body))
        return F.concat(_let(F.struct(cuts.alias("cuts")), lambda x: _let(F.struct(
            x["cuts"].alias("cuts"), F.ceil(F.sqrt(F.size(x["cuts"]))).cast("int").alias("length")), pieces)), tail)

    def pieces(x):
        def group(cuts):
            begin, end = cuts[0]["begin"], F.element_at(cuts, -1)["end"]
            return _let(F.struct(F.substring(body, begin + 1, end - begin).alias("part"), begin.alias("begin")), lambda y: F.array_join(
                F.transform(cuts, lambda c: F.concat(F.substring(
                    y["part"], c["begin"] - y["begin"] + 1, c["end"] - c["begin"]), F.lit(mask))), ""))

        starts = _groups(F.size(x["cuts"]), x["length"])
        return F.array_join(F.transform(starts, lambda at: _let(F.slice(x["cuts"], at, x["length"]), group)), "")

    return _let(spans, kept)


def redact_secrets(docs, text="text", mask="[SECRET]", **options):
    """The input's rows and columns with every span found replaced by `mask`; overlapping spans become one.

    Null texts stay null. See `find_spans` for the rest.
    """
    body = F.col(f"doc.`{text}`")
    clean = F.when(F.size("all") > 0, _masked(body, F.array_sort("all"), mask)).otherwise(body)
    return find_spans(docs, text=text, **options).select(
        *[(clean if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
