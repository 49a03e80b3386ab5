"""Mixing sources to target weights by Poisson replication and a global shuffle.

A document of source s is repeated Poisson(r) times, r being the source's mean repetition rate:
target share of s, times all documents, times epochs, over the documents of s. The Poisson draw
inverts the distribution at a number in [0, 1) taken from the md5 of seed and doc_id, so it never
depends on partitioning or retries. The copies get a key from the md5 of seed, doc_id and copy, are
dealt to partitions by its hash and sorted by it there: one shuffle, whatever the sources' sizes.

Defined results: a null source is a source of its own (its key is the empty text, shared with the
empty source); a null doc_id draws as the empty text; rows that repeat a doc_id get the same count.
An empty table gives an empty table. Columns named like the added ones (copy, mix_key) are replaced;
any other column is carried, whatever its name.

Rates are broadcast for the sources that make up 1 / ``BROADCAST_SOURCES`` of all rows or more, so for
that many sources at most; rows of the other sources, none of which is large, are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import table

#: A larger rate is drawn as a sum of so many independent draws that each has at most this mean.
MOST_RATE = 64.0
#: Points of the inverted distribution; beyond the mean plus 12 standard deviations nothing is left of 52 bits.
POINTS = int(MOST_RATE + 12 * MOST_RATE**0.5) + 20
#: Sources whose rates (about 1.5 KB each) are broadcast.
BROADCAST_SOURCES = 2_000
TEMPERATURE = 0.5
SEED = 20


def _unit(*parts) -> F.Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(sources: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> tuple[DataFrame, int, int]:
    """Of sources(source): source, documents, number of draws and the distribution of one draw; all documents; the number of sources."""
    n = sources.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        of = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(of[F.col("source")].cast("double"), F.lit(0.0))
    n = n.withColumn("weight", weight)
    total = n.agg(F.sum("n"), F.sum("weight"), F.count(F.lit(1))).first()
    rate = F.round(F.lit(float(epochs) * float(total[0] or 0)) * F.col("weight") / F.lit(float(total[1] or 1)) / F.col("n"), 9)
    n = n.select("source", "n", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int"))
    n = n.withColumn("one", F.col("rate") / F.col("draws"))
    cdf = F.expr(
        f"""aggregate(sequence(1, {POINTS}), struct(exp(-one) as p, array(exp(-one)) as c),
            (a, k) -> struct(a.p * one / k as p, concat(a.c, array(element_at(a.c, -1) + a.p * one / k)) as c), a -> a.c)"""
    )
    return n.select("source", "n", "draws", cdf.alias("cdf")), int(total[0] or 0), int(total[2])


def mix(
    df: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """df's rows by their counts, in mixed order, with copy (from 0) and mix_key.

    weights: target share of each source (those left out get none); None: document count to the
    power temperature. epochs: documents to give out for each document of df, on average."""
    df = df.drop("copy", "mix_key")
    rows = df.select(F.coalesce(df["source"], F.lit("")).alias("source"), df["doc_id"].cast("string").alias("id"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    rate, total, sources = rates(rows.select("source"), weights, temperature, epochs)
    if sources <= broadcast_sources:
        out = rows.join(F.broadcast(rate), "source")
    else:
        large = F.col("n") * broadcast_sources >= total
        near = rows.join(F.broadcast(rate.where(large)), "source", "left")
        rest = near.where("n is null").select(rows.columns).join(rate.where(~large), "source")
        out = near.where("n is not null").unionByName(rest)
    # the draw is one value for each of `draws` numbers: the points of the distribution at or below it
    places = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: _unit(F.lit(seed), F.col("id"), j))
    count = F.aggregate(places, F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c <= u)))
    out = out.select("row", "id", count.alias("count")).where("count > 0").select("row", "id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), F.coalesce("id", F.lit("")), F.col("copy")).cast("binary"))
    out = out.select("row.*", "copy", key.alias("mix_key"))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle_sql(documents: str = "documents") -> str:
    return f"""
    with d as (select doc_id, text, lang, source, n_chars, coalesce(source, '') as src from {documents}),
    s as (select src, count(*) as n from d group by src),
    t as (select sum(n)::double as all_n, sum(pow(n::double, {TEMPERATURE})) as all_w from s),
    r as (select src, round(all_n * pow(n::double, {TEMPERATURE}) / all_w / n, 9) as rate from s, t),
    m as (select src, greatest(1, ceil(rate / {MOST_RATE}))::int as draws, rate / greatest(1, ceil(rate / {MOST_RATE})) as one from r),
    p as (select src, k, sum(exp(k * ln(one) - one - lgamma(k + 1))) over (partition by src order by k) as c from m, range(0, {POINTS + 1}) x(k)),
    u as (select doc_id, any_value(src) as src, j, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || j::varchar), 1, 13))::bigint / {2**52}::double as u
          from (select distinct doc_id, src, unnest(range(1, draws + 1)) as j from d join m using (src)) group by doc_id, j),
    c as (select doc_id, count(*) as n from u join p using (src) where p.c <= u.u group by doc_id),
    x as (select d.*, unnest(range(0, c.n)) as i from d join c using (doc_id))
    select doc_id, text, lang, source, n_chars, i::int as copy, md5('{SEED}s|' || coalesce(doc_id::varchar, '') || '|' || i::varchar) as mix_key from x"""
