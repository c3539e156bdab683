"""Mixing sources to target weights, by blocks.

1. Every source's documents are laid end to end in a pseudorandom order (by a hash of doc_id); the resulting stream of tokens is
   cut into blocks of BLOCK tokens, the last of which may be shorter.
2. Targets: weight times a common level, at most MAX_EPOCHS times the source's size, the level chosen so that they add up
   to the wanted total. That's what resharing the excess by weight, again and again, ends at.
3. A source fills a number of output slots: each whole epoch takes all of its blocks, and a partial one those it still needs, the last of
   them cut. Within an epoch, place k holds block permute(k), a pseudorandom permutation of the source's block indexes
   (swap-or-not, Hoang, Morris and Rogaway, 2012), so that a slot finds its block by arithmetic, without a sort.
4. Output shards have SHARD_SLOTS slots. How many of a shard's slots go to each source is a multinomial draw with the sources' shares of all
   slots. Over all shards a source is then drawn a little more or less often than it has places to fill, so the draw is conditioned on those
   totals: a source's drawn slots, counted through all shards, are mapped through a pseudorandom permutation too; what lands beyond its
   last place is handed, in pseudorandom order, to the sources that were drawn too seldom. As drawn slots are exchangeable, the
   counts of the shards are then those of the multivariate hypergeometric distribution, and every source comes out at its target.
5. Blocks are joined by (source, index) to the documents that they overlap; what a document gives to each slot is a span of its tokens.

DataFrame expressions only. Nothing groups all rows of a source in one task: offsets within a source are sums over
hash buckets first and within a bucket second, and a shard's place among a source's drawn slots is a sum over runs of shards first. What is
broadcast is one row with a few numbers for each source.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK = 256
SHARD_SLOTS = 4096
BUCKETS = 8192
RUN = 1024  # shards that are added up at once
SLOTS_PER_TASK = 50_000
ROUNDS = 24
SEED = 20


def size_of(text: Column) -> Column:
    """Number of words: runs without ASCII white space. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def permute(k: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, chosen by key, applied to k: swap-or-not."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mate)).bitwiseAND(F.lit(1).cast("long")) == 1, mate).otherwise(x)

    return F.aggregate(rounds, k.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds rank, weight and target. Sources by code point, null last, weigh
    what `weights` says, repeating. The windows below run over one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1))
    # sources in the order in which a rising level meets their caps; after i of them are full, the rest shares what's left
    filling = weighed.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    levelled = filling.withColumn("level", level)
    reached = levelled.withColumn("reached", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    return reached.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(F.col("reached") * F.col("weight"), F.col("cap"))))).select("source", "source_size", "rank", "weight", "target")


def lay_out(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, version, source, size). Adds start: the document's offset in its source's stream. version, a hash of the text, tells rows without
    doc_id apart."""
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.col("version"), F.lit(SEED)), F.lit(BUCKETS)).cast("int"))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("bucket_start", F.coalesce(F.sum("held").over(ahead), F.lit(0))).withColumnsRenamed({"source": "s", "bucket": "b"}).drop("held")
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", "version", F.lit(SEED + 1)), "doc_id", "version", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b"))).select("doc_id", "version", "source", "size", (F.col("bucket_start") + F.col("within")).alias("start"))


def _upto(x: Column, sums: Column, steps: int) -> Column:
    """How many of the rising sums are at most x, by halving, in `steps` steps."""
    start = F.struct(F.lit(0).alias("lo"), F.size(sums).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        more = (s["lo"] < s["hi"]) & (F.get(sums, mid) <= x)
        return F.struct(F.when(more, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(more | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def _in_order(value: Column) -> Column:
    """An array with one entry for each source, by rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"])


def _running(of: Column) -> Column:
    """Sums up to and with each entry."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit([]).cast("array<bigint>").alias("sums"))
    return F.aggregate(of, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["sums"], s["sum"] + x).alias("sums")))["sums"]


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows, with the columns of a frame of one row, whose top is 0, beside each; shard numbers are below 2 ** 62, which makes the key 0."""
    return rows.withColumn("top", F.shiftright("shard", 62)).join(F.broadcast(one), "top").drop("top")


def places(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """plan, with each source's blocks, its whole epochs, the tokens of the partial one, and n: the slots that it's offered."""
    full = F.floor(F.col("wanted") / F.col("source_size"))
    per = plan.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("wanted", F.round("target").cast("long"))
    per = per.withColumn("epochs", full).withColumn("rest", F.col("wanted") - full * F.col("source_size"))
    # the partial epoch may meet the short last block and then needs one block more: it's offered ceil(rest / block) + 1
    return per.withColumn("n", F.col("epochs") * F.col("blocks") + F.least(F.when(F.col("rest") > 0, F.ceil(F.col("rest") / block) + 1).otherwise(F.lit(0)), F.col("blocks"))).where("n > 0")


def draws(per: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """per: places(). The multinomial draw: shard, at (the source's place by rank), size (of the shard), drawn (slots)."""
    spark = per.sparkSession
    sources, slots_in_all = per.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-slots_in_all // shard_slots)
    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, -(-slots_in_all // SLOTS_PER_TASK))))
    size = F.least(F.lit(shard_slots).cast("long"), F.lit(slots_in_all).cast("long") - F.col("shard") * shard_slots)
    each = _beside(spark.range(0, shards, 1, tasks).select(F.col("id").alias("shard"), size.alias("size")), per.agg(_running(_in_order(F.col("n"))).alias("sums"), (F.min("n") * 0).alias("top")))
    source = lambda slot: _upto(F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", slot), F.lit(slots_in_all).cast("long")), F.col("sums"), sources.bit_length())
    drawn = each.select("shard", "size", F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), source).alias("sources"))
    return drawn.select("shard", "size", F.explode("sources").alias("at")).groupBy("shard", "size", "at").agg(F.count("*").alias("drawn"))


def slots(plan: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """plan: targets(). One row a slot: shard, slot, rank (of the source), epoch, block_index, tokens."""
    per = cut(places(plan, block))
    drawn = cut(draws(per, shard_slots))
    # where a shard's drawn slots of a source begin among all of them: runs of shards first
    runs = drawn.groupBy("at", F.floor(F.col("shard") / RUN).alias("run")).agg(F.sum("drawn").alias("held"))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("at", "run", F.coalesce(F.sum("held").over(ahead("at", "run")), F.lit(0)).alias("run_start"))
    begun = drawn.withColumn("run", F.floor(F.col("shard") / RUN)).withColumn("before", F.coalesce(F.sum("drawn").over(ahead("at", "run", "shard")), F.lit(0)))
    begun = begun.withColumn("offset", F.coalesce(F.sum("drawn").over(ahead("shard", "at")), F.lit(0))).join(runs, ["at", "run"]).withColumn("before", F.col("before") + F.col("run_start"))
    # one row with what is known of each source; a source that was never drawn counts as drawn 0 times
    at = per.select("*", (F.row_number().over(Window.orderBy("rank")) - 1).alias("at"))  # one row a source
    known = at.join(drawn.groupBy("at").agg(F.sum("drawn").alias("c")), "at", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    lack, over = F.greatest(F.col("n") - F.col("c"), F.lit(0)), F.greatest(F.col("c") - F.col("n"), F.lit(0))
    names = ["rank", "source_size", "blocks", "epochs", "rest", "n", "c"]
    one = known.agg(*[_in_order(F.col(x).cast("long")).alias(f"{x}_of") for x in names], _running(_in_order(lack)).alias("lacks"), _running(_in_order(over)).alias("overs"), F.count("*").alias("k"), (F.min("n") * 0).alias("top"))
    one = cut(one.withColumn("moved", F.coalesce(F.try_element_at("lacks", F.lit(-1)), F.lit(0))))
    sources, moved = one.select("k", "moved").first()
    tasks = max(per.sparkSession.sparkContext.defaultParallelism, -(-(per.agg(F.sum("n")).first()[0] or 0) // SLOTS_PER_TASK))
    dealt = _beside(begun.select("shard", "size", "at", "drawn", "before", "offset").repartition(tasks, "shard", "at"), one)
    steps = int(sources).bit_length()

    def bound(x: Column, f) -> Column:
        return F.get(F.transform(F.array(x), f), 0)

    def place(k: Column) -> Column:
        of = lambda x: F.get(f"{x}_of", F.col("at"))
        own = permute(F.col("before") + k, of("c"), F.xxhash64(F.lit(SEED + 3), of("rank")))
        beyond = lambda p: F.get("overs", F.col("at")) - (of("c") - of("n")) + p - of("n")
        given = lambda p: permute(beyond(p), F.lit(max(1, moved)).cast("long"), F.xxhash64(F.lit(SEED + 4)))
        # a transform over an array of one binds what is used more than once
        lacking = lambda g: bound(_upto(g, F.col("lacks"), steps), lambda j: F.struct(j.alias("at"), (F.get("n_of", j) - (F.get("lacks", j) - g)).alias("k")))
        return bound(own, lambda p: F.when(p < of("n"), F.struct(F.col("at").alias("at"), p.alias("k"))).otherwise(bound(given(p), lacking)))

    def slot(k: Column) -> Column:
        number = permute(F.col("offset") + k, F.col("size"), F.xxhash64(F.lit(SEED + 5), "shard"))
        of = lambda x, p: F.get(f"{x}_of", p["at"])
        fill = lambda p: F.struct(number.alias("slot"), p["k"].alias("k"), *[of(x, p).alias(x) for x in ("rank", "source_size", "blocks", "epochs", "rest")])
        return bound(place(k), fill)

    made = dealt.select("shard", F.transform(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1), slot).alias("made")).select("shard", F.explode("made").alias("m")).select("shard", "m.*")
    epoch, step = F.floor(F.col("k") / F.col("blocks")), F.col("k") % F.col("blocks")
    each = made.withColumn("epoch", epoch).withColumn("step", step).withColumn("block_index", permute(F.col("step"), F.col("blocks"), F.xxhash64(F.lit(SEED), "rank", "epoch")))
    held = F.least(F.lit(block), F.col("source_size") - F.col("block_index") * block)
    # tokens before this place in the partial epoch: whole blocks, less what the short block lacks if it came before
    short = F.col("blocks") * block - F.col("source_size")
    last_at = permute_inverse(F.col("blocks") - 1, F.col("blocks"), F.xxhash64(F.lit(SEED), "rank", "epoch"))
    used = F.col("step") * block - F.when(last_at < F.col("step"), short).otherwise(F.lit(0))
    tokens = F.when(F.col("epoch") < F.col("epochs"), held).otherwise(F.greatest(F.least(held, F.col("rest") - used), F.lit(0)))
    return each.withColumn("tokens", tokens).where("tokens > 0").select("shard", "slot", "rank", "epoch", "block_index", "tokens")


def permute_inverse(y: Column, n: Column, key: Column) -> Column:
    """Where permute has y: each round is its own inverse, so the rounds run backwards."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))

    def swap(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mate)).bitwiseAND(F.lit(1).cast("long")) == 1, mate).otherwise(x)

    return F.aggregate(rounds, y.cast("long"), swap)


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents, manifest) of a mix.

    docs: doc_id, source, text; other columns are ignored.
    documents: doc_id, version (hash of the text), source, size, source_size, target, start (offset in the source's stream).
    manifest: shard, slot, source, epoch, block_index, doc_id, first_word, n_words: the spans of words that fill the slots, in no order;
    within a slot, spans stand by the document's start.

    A null text has size 0 and gives nothing; a null source is a source of its own. Repeated rows are documents like others. A null doc_id
    is laid out like any other id. An empty table, or one without a word, gives an empty manifest. Reruns give the same mix.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "source", size_of(F.col("text")).alias("size")))
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    placed = cut(lay_out(sized))
    named = placed.join(plan.withColumnRenamed("source", "s"), placed["source"].eqNullSafe(F.col("s"))).select("doc_id", "version", "source", "size", "source_size", "target", "start", "rank")
    over = named.where("size > 0").withColumn("block_index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    spans = over.join(slots(plan, block, shard_slots).hint("merge"), ["rank", "block_index"])  # both grow with the words
    begin = F.greatest(F.col("start"), F.col("block_index") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block_index") * block + F.col("tokens"))
    manifest = spans.where(end > begin).select("shard", "slot", "source", "epoch", "block_index", "doc_id", "start", (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"))
    return named.drop("rank"), manifest


def taken(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """documents with taken: the words that the mix takes from each, repeats counted. (source, start) tells rows of one doc_id apart."""
    used = manifest.groupBy("source", "doc_id", "start").agg(F.sum("n_words").alias("taken")).withColumnsRenamed({"source": "s", "doc_id": "d", "start": "at"})
    same = documents["source"].eqNullSafe(F.col("s")) & documents["doc_id"].eqNullSafe(F.col("d")) & (documents["start"] == F.col("at")) & (documents["size"] > 0)
    return documents.join(used, same, "left").select(*documents.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The rows of docs that a mix takes words of, with size, source_size, target and taken added (replacing columns of those names).

    A row is known by doc_id, text and source; of rows that are the same in these each has its own words in the mix. Rows without doc_id are
    documents like others; those without a word aren't taken.
    """
    made = ["size", "source_size", "target", "taken"]
    key = {"__mix_doc": F.col("doc_id").cast("long"), "__mix_version": F.xxhash64("text"), "__mix_source": F.col("source")}
    documents, manifest = mix(docs, block, shard_slots)
    used = cut(taken(documents, manifest).select(F.col("doc_id").alias("__mix_doc"), F.col("version").alias("__mix_version"), F.col("source").alias("__mix_source"), "start", *made))
    counts = used.groupBy(*key).agg(F.count("*").alias("n"))
    repeated = cut(counts.where("n > 1").drop("n"))

    def beside(a: DataFrame, b: DataFrame, how: str, *more: str) -> DataFrame:
        b = b.withColumnsRenamed({k: f"{k}_" for k in [*key, *more]})
        same = [a[k].eqNullSafe(b[f"{k}_"]) for k in [*key, *more]]
        out = a.join(b, functools.reduce(lambda x, y: x & y, same), how)
        return out.drop(*[f"{k}_" for k in [*key, *more]]) if how == "inner" else out

    rows = docs.drop(*made).withColumns(key)
    once = beside(beside(rows, repeated, "left_anti"), beside(used, repeated, "left_anti").drop("start"), "inner")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    several = beside(beside(rows, repeated, "left_semi").withColumn("__mix_copy", number), beside(used, repeated, "left_semi").withColumn("__mix_copy", F.row_number().over(Window.partitionBy(*key).orderBy("start"))).drop("start"), "inner", "__mix_copy")
    return once.unionByName(several.drop("__mix_copy")).where("taken > 0").drop(*key)


def query(spark, sf_dir: str) -> DataFrame:
    documents, manifest = mix(table(spark, sf_dir, "documents"))
    return taken(documents, manifest).select("doc_id", "size", "source_size", "target", "taken")
