"""Personal data: base patterns, and bootstrapped contextual extraction for what they miss.

Base matches are the seeds. The one and two words before a mention are its lexical patterns. Spark scores the
graph of patterns and instances in rounds: a pattern is as trustworthy as the share of trusted instances among those that speak
for or against it, given enough different ones, and an instance as its patterns together (noisy or). Against a pattern of a kind
speak base mentions of other kinds after the same words; identifiers that nothing is known of yet count by the logarithm of their number
only, so that what a pattern is there to find doesn't sink it. Trusted patterns thus discover identifiers of looser shapes (no top-level domain, spelled-out at and dot, phone numbers without
a plus, IPv6, cards with other separators); those of enough trust become spans unless a base span overlaps.

All of it is DataFrame and SQL functions. Texts are scanned once, in time linear in their length; matches become rows,
running sums of what lies between them give their places, and the graph is aggregated from them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, stage

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. As given, but possessive, and starting only where a run starts or the last match ended: the
#: same leftmost matches in linear time, also in very long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes that only trusted patterns turn into spans.
LOOSE = {
    "email": r"(?<![^\s<\(\[\"'])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?![A-Za-z0-9.@-])|\x20?[\(\[]at[\)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\(\[]dot[\)\]]\x20?|\.)[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])",
    "phone": r"(?<![0-9+.A-Za-z-])(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{3,5}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z-])",
}
#: A character without which a text has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE_NEEDS = {"email": r"@|[\(\[]at[\)\]]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9][\x20./-][0-9]{3}"}
#: Rounds; different trusted instances that a pattern needs; trust from which patterns and instances count.
ROUNDS, SUPPORT, TRUST = 3, 5, 0.8
#: Spans that are cut from one stretch of a text.
PIECES = 500
MARK = "array<struct<kind:string,base:boolean,gap:int,size:int,ok:boolean,inst:string,ctx:array<string>>>"


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(text: str) -> str:
    """SQL: whether the digits of a string pass Luhn's check."""
    digit = "cast(substr(d, -i, 1) as int)"
    step = f"(c, i) -> c + if(i % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0))"
    return f"exists(array({digits(text)}), d -> aggregate(sequence(1, length(d)), 0, {step}) % 10 = 0)"


def valid(kind: str, text: str) -> str:
    if kind == "ip":
        return f"forall(split({text}, '[.]'), p -> p rlike '^0*([0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$')"
    if kind == "card":
        return f"length({digits(text)}) between 12 and 19 and {luhn(text)}"
    if kind == "phone":
        return f"length({digits(text)}) between 9 and 15"
    return "true"


def contexts(gap: str) -> str:
    """SQL: the lexical patterns of a mention: the one and two words before it on its line and after any mention of its kind; the last must have a letter."""
    last = f"trim(regexp_replace(translate(lower(substring_index({gap}, '\\n', -1)), '\\t', ' '), ' +', ' '))"
    two = "substring_index(w, ' ', -2)"
    return f"flatten(transform(array({last}), w -> filter(array(concat('1:', substring_index(w, ' ', -1)), if(contains({two}, ' '), concat('2:', {two}), null)), y -> y is not null and y rlike '\\\\p{{L}}')))"


def marks(kind: str, base: bool, pattern: str, test: str, check: str) -> Column:
    """The matches of a pattern in t in order: what is between them (characters), their own, whether they are valid, text and contexts."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    one = f"named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'gap', length(g), 'size', length(m), 'ok', m is not null and ({check.replace('x.m', 'm')}), 'inst', m, 'ctx', if(m is null, array(), {contexts('g')}))"
    found = f"filter(zip_with(split(t, '{p}', -1), regexp_extract_all(t, '{p}', 0), (g, m) -> {one}), x -> x.inst is not null)"
    return F.expr(f"cast(if({test}, {found}, array()) as {MARK})")


def _in_order(x: Column, y: Column) -> Column:
    """Order of spans: start, then kind as listed, then end."""
    rank = lambda a: F.array_position(F.array(*[F.lit(k) for k in KINDS]), a["kind"])
    key = lambda a: F.struct(a["s"], rank(a), a["e"])
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def mentions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged rows (rid, doc_id), and their mentions (rid, kind, s, e, base, inst, ctx): base ones, and loose ones that no base one overlaps."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = []
    for kind in KINDS:
        need = NEEDS[kind]
        found.append(marks(kind, True, BASE[kind], f"contains(t, '{need}')" if need else "t rlike '[0-9]'", valid(kind, "x.m")))
        need = LOOSE_NEEDS[kind].replace("\\", "\\\\")
        found.append(marks(kind, False, LOOSE[kind], f"t rlike '{need}'", valid(kind, "x.m") if kind in ("card", "phone") else "true"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*found).alias("marks")), "marks")
    every = rows.select("rid", F.posexplode("marks").alias("i", "m")).select("rid", "i", "m.*")
    placed = every.withColumn("e", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "kind", "base").orderBy("i")).cast("int"))
    placed = placed.where("ok").select("rid", "kind", "base", (F.col("e") - F.col("size")).alias("s"), "e", F.lower("inst").alias("inst"), "ctx")
    up, down = (Window.partitionBy("rid").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("s"), F.desc("s")))
    before, after = F.max(F.when(F.col("base"), F.col("e"))).over(up), F.min(F.when(F.col("base"), F.col("s"))).over(down)
    free = F.coalesce(before <= F.col("s"), F.lit(True)) & F.coalesce(after >= F.col("e"), F.lit(True))
    kept = placed.withColumn("free", free).where("base or free").drop("free")
    return rows.select("rid", "doc_id"), stage(kept, "mentions")


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(kind, inst): loose instances that trusted patterns vouch for, from the graph of patterns and instances.

    With `sure` trusted instances, `other` ones of other kinds after the same words and `open` ones of which nothing is known, a pattern
    scores sure / (sure + other + log2(1 + open)).
    """
    edges = found.select("kind", "inst", F.explode("ctx").alias("ctx"), F.col("base").cast("int").alias("seed")).distinct()
    edges = stage(edges, "pattern-graph")
    loose = edges.where("seed = 0")
    counts = edges.groupBy("kind", "ctx").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n"))
    # The rows of a context are its kinds, four at most.
    others = counts.withColumn("other", F.sum("seeds").over(Window.partitionBy("ctx")) - F.col("seeds"))
    seeds = stage(others.where(F.col("n") >= support), "patterns")
    trusted = None
    for _ in range(rounds):
        if trusted is None:
            scored = seeds.withColumn("sure", F.col("seeds").cast("double"))
        else:
            more = loose.join(trusted, ["kind", "inst"]).groupBy("kind", "ctx").agg(F.sum("conf").alias("more"))
            scored = seeds.join(more, ["kind", "ctx"], "left").withColumn("sure", F.col("seeds") + F.coalesce("more", F.lit(0.0)))
        score = F.col("sure") / (F.col("sure") + F.col("other") + F.log2(1 + F.greatest(F.col("n") - F.col("sure"), F.lit(0.0))))
        good = scored.where((F.col("sure") >= support) & (score >= trust)).select("kind", "ctx", F.least(score, F.lit(0.999)).alias("p"))
        conf = 1 - F.exp(F.sum(F.log(1 - F.col("p"))))
        trusted = stage(loose.join(good, ["kind", "ctx"]).groupBy("kind", "inst").agg(conf.alias("conf")).where(F.col("conf") >= trust), "trusted")
    return trusted.select("kind", "inst")


def _written(spans_: str) -> Column:
    return F.expr(f"array_join(transform({spans_}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """A row per document row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and discovered).

    Null and empty texts have no spans. Null and repeated doc_ids keep a row each. Other columns are not read. Empty in, empty out.
    """
    rows, found = mentions(docs)
    new = found.where("not base").join(small(stage(discovered(found), "discovered")), ["kind", "inst"], "left_semi")
    parts = found.where("base").unionByName(new).groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e", "base")).alias("every"))
    rows = rows.join(parts, "rid", "left").withColumn("every", F.array_sort(F.coalesce("every", F.array().cast("array<struct<kind:string,s:int,e:int,base:boolean>>")), _in_order))
    rows = rows.withColumn("base", F.filter("every", lambda x: x["base"]))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("every").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with what the spans of `find` cover in text replaced by the kind in angle brackets; spans that overlap are one, of the first's kind.

    Texts are looked up by their digest, so null and repeated doc_ids are masked too; equal texts are searched once.
    Null texts stay null. Other columns pass through, whatever they are called. Empty in, empty out.
    """
    key, cuts = fresh(docs, "_text_key", "_cuts")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    texts = keyed.where(F.col("text").isNotNull()).select(F.col(key).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    parts = find(texts).where("spans != ''").select(F.col("doc_id").alias("k"), F.explode(F.split("spans", ",")).alias("x")).select("k", F.split("x", ":").alias("x"))
    rows = parts.select("k", F.col("x")[0].alias("kind"), F.col("x")[1].cast("int").alias("s"), F.col("x")[2].cast("int").alias("e"))
    order = Window.partitionBy("k").orderBy("s", "e", "kind")
    ended = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.coalesce(ended <= F.col("s"), F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("i", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("k", "i").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("kind", F.struct("s", "e", "kind")).alias("kind"))
    whole = whole.withColumn("at", F.coalesce(F.lag("e").over(Window.partitionBy("k").orderBy("i")), F.lit(0)))
    found = whole.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "s", "e", "kind"))).alias(cuts)).withColumnRenamed("k", key)
    # Pieces are taken from stretches of the text of PIECES spans each, so that a text of very many spans isn't walked from its start for each.
    piece = "concat(substr(y.part, x.at - y.at + 1, x.s - x.at), '<', x.kind, '>')"
    stretch = f"transform(sequence(0, size({cuts}) - 1, {PIECES}), i -> struct(slice({cuts}, i + 1, {PIECES}) as c))"
    stretch = f"transform({stretch}, y -> struct(y.c as c, y.c[0].at as at, substr(text, y.c[0].at + 1, element_at(y.c, -1).e - y.c[0].at) as part))"
    masked = F.expr(f"concat(array_join(transform({stretch}, y -> array_join(transform(y.c, x -> {piece}), '')), ''), substr(text, element_at({cuts}, -1).e + 1))")
    return keyed.join(found, key, "left").withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(masked)).select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """`find` over all documents; nulls, empties and repeats as it says."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
