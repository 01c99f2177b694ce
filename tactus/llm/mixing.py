"""Mixing sources to target weights, with DataFrame functions alone.

1. Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target
   stops at `most_repeats` times its source's size and the excess is shared again by weight until none is above.
2. Each source's words, document after document, are packed into blocks of `block_words` words (its last block may
   be shorter). A target becomes a quota of blocks.
3. Every slot of every output shard draws a source by the quotas' shares, so the counts of the sources in a shard are
   multinomial. Draws over all shards miss a small source's quota by their standard deviation; so slots beyond a
   source's quota, the last ones, go to the sources that lack some: as few slots as can be.
4. A source's slots in order are mapped through a pseudorandom permutation of its block numbers, another one for
   each epoch, so no block comes twice before all have come once. Slots and blocks are joined by block number.

The join by number is one of numbers alone. A text travels once: to the list of what is taken of it. The mix is a row
for each piece of a document in a slot of a shard, with its words; reports and documents are derived from it.

The tables held together in one task are those of sources and of a source's buckets. A source with any share of
the rows is spread over buckets and blocks, and a row that is repeated very often over parts of its bucket. Everything
follows from ids, texts, sizes and the seed, so reruns agree.

Null and empty texts have size 0 and are never taken. Repeated rows are taken each for itself. An empty table gives
no row. Rows are kept whole inside one column, so no input column can clash with those made here; where a result has a
column of its own by an input column's name, that input column isn't part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.llm.text import SPACE
from tactus.session import durable

# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
#: Rows of a bucket, about; and the most kinds of often repeated rows that get parts of their own.
BUCKET_ROWS = 1 << 13
MOST_REPEATED = 10_000
ROUNDS = 6
#: Entries of a running sum that are summed in one window.
CHUNK = 4096
#: Entries of the guide by which a place is found among ranges.
GUIDES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at x. All are long; n is 1 at least.

    The numbers fill a grid of about sqrt(n) columns, its last row ragged. Each round turns every column, then
    every row, by a hashed amount: bijections on the grid as it is, whatever n.
    """
    width = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def turn(at: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, turn_column(at, r)).otherwise(turn_row(at, r))

    def turn_column(at: Column, r: Column) -> Column:
        column, row = at % width, F.floor(at / width).cast("long")
        height = F.floor((n - 1 - column) / width).cast("long") + 1
        return (row + F.pmod(F.xxhash64(key, r, column), height)) % height * width + column

    def turn_row(at: Column, r: Column) -> Column:
        column, row = at % width, F.floor(at / width).cast("long")
        length = F.least(width, n - row * width)
        return row * width + (column + F.pmod(F.xxhash64(key, r, row), length)) % length

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), x, turn)


def source_plan(sizes: DataFrame, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """From (source, source_size): rank, weight, target, blocks, quota and slot_from for each source."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sizes.withColumn("rank", F.row_number().over(ordered).cast("long") - 1)
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS)).cast("int") + 1).cast("double"))
    ranked = ranked.withColumn("_most", (F.col("source_size") * most_repeats).cast("double"))
    everything = W.partitionBy()
    # From the source that is full first: the level that the weights reach if all before it are full.
    filling = W.orderBy(F.col("_most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("_most").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = ranked.withColumn("_level", (F.sum("source_size").over(everything) - before) / open_weight)
    free = F.col("_most") > F.col("_level") * F.col("weight")
    level = F.min_by("_level", F.when(free, F.struct(F.col("_most") / F.col("weight"), F.col("rank")))).over(everything)
    leveled = leveled.withColumn("_final", level)
    target = F.when(F.col("_final").isNull(), F.col("_most")).otherwise(F.least("_most", F.col("_final") * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    return (
        leveled.withColumn("target", target)
        .withColumn("blocks", blocks)
        .withColumn("quota", F.least(quota, F.col("blocks") * most_repeats))
        .withColumn("slot_from", F.sum("quota").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("quota"))
        .withColumn("slots", F.sum("quota").over(everything))
        .select("source", "rank", "source_size", "weight", "target", "blocks", "quota", "slot_from", "slots")
    )


def _none() -> Column:
    return F.lit(0).cast("long")


def sums_before(rows: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows of the same `by` with a smaller `at` (a long), in chunks."""
    chunked = rows.withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    whole = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunked.groupBy(by, "_chunk").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(whole), _none()))
    within = W.partitionBy(by, "_chunk").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    summed = chunked.withColumn("_within", F.coalesce(F.sum(value).over(within), _none()))
    return summed.join(chunks.drop("_sum"), [by, "_chunk"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_chunk", "_base", "_within")


def located(rows: DataFrame, at: Column, ranges: DataFrame, start: str, size: str, total: int) -> DataFrame:
    """Each row with the columns of the range that holds `at`, nulls where none does (at null).

    ranges: start and size within 0 .. total - 1, apart from each other. A guide leads from equal steps of the whole to the
    ranges that meet them: at most GUIDES rows more than there are ranges, so Spark broadcasts it if it is small.
    """
    step = max(1, -(-total // GUIDES))
    meets = F.sequence(F.floor(F.col(start) / step), F.floor((F.col(start) + F.col(size) - 1) / step))
    guide = ranges.where(F.col(size) > 0).withColumn("_guide", F.explode(meets)).alias("g")
    placed = rows.withColumn("_at", at).withColumn("_step", F.floor(F.col("_at") / step))
    inside = (F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(start) + F.col(size))
    return placed.join(guide, (F.col("_step") == F.col("_guide")) & inside, "left").drop("_step", "_guide")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _drawn(plan: DataFrame, seed: int, shard_blocks: int, slots: int) -> DataFrame:
    """(shard, slot, rank): the source that each slot draws, by the quotas' shares."""
    every = plan.sparkSession.range(0, slots, 1, _tasks(plan))
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, slots)))
    ranges = plan.select("rank", "slot_from", "quota")
    shard, slot = F.floor(F.col("id") / shard_blocks).alias("shard"), (F.col("id") % shard_blocks).alias("slot")
    return located(every, at, ranges, "slot_from", "quota", slots).select(shard, slot, "rank")


def dealt_slots(plan: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """plan: written. (shard, slot, rank, blocks, number): each slot's source, after the quotas, and the slot's number in it."""
    slots = plan.agg(F.max("slots")).first()[0] or 0  # one number
    drawn = _drawn(plan, seed, shard_blocks, slots)
    counts = durable(drawn.groupBy("rank", "shard").agg(F.count("*").alias("drawn")), "mix-draws")
    ordered = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    sums = plan.join(counts.groupBy("rank").agg(F.sum("drawn").alias("drawn")), "rank", "left").na.fill(0, ["drawn"])
    sums = sums.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), _none()), "lack": F.greatest(F.col("quota") - F.col("drawn"), _none())})
    sums = sums.withColumns({f"{k}_from": F.coalesce(F.sum(k).over(ordered), _none()) for k in ("over", "lack")})  # a row for each source
    quotas = durable(sums.select("rank", "blocks", "quota", "drawn", "over_from", "lack", "lack_from"), "mix-quotas")
    moved = quotas.agg(F.sum("lack")).first()[0] or 0  # one number

    place = W.partitionBy("rank", "shard").orderBy("slot")  # at most a shard's blocks
    numbered = drawn.withColumn("_k", F.row_number().over(place).cast("long") - 1)
    numbered = numbered.join(sums_before(counts, "rank", "shard", "drawn", "before").drop("drawn"), ["rank", "shard"])
    own = numbered.withColumn("number", F.col("before") + F.col("_k")).join(quotas.select("rank", "blocks", "quota", "over_from"), "rank")
    beyond = F.when(F.col("number") >= F.col("quota"), F.col("over_from") + F.col("number") - F.col("quota"))
    lacking = quotas.select(F.col("rank").alias("to"), F.col("blocks").alias("to_blocks"), F.col("drawn").alias("to_drawn"), "lack", "lack_from")
    given = located(own, beyond, lacking, "lack_from", "lack", moved)
    number = F.when(F.col("to").isNull(), F.col("number")).otherwise(F.col("to_drawn") + F.col("_at") - F.col("lack_from"))
    return given.select("shard", "slot", F.coalesce("to", "rank").alias("rank"), F.coalesce("to_blocks", "blocks").alias("blocks"), number.alias("number"))


def shard_slots(plan: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """plan: written. (shard, slot, rank, block): the block of its source that each slot takes."""
    dealt = dealt_slots(plan, seed, shard_blocks)
    epoch = F.floor(F.col("number") / F.col("blocks"))
    block = permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "rank", epoch))
    return dealt.select("shard", "slot", "rank", block.alias("block"))


def words_of(text: Column, pieces: Column) -> Column:
    """The pieces (piece_from, piece_words) of the text with their words: each with the white space after it, the first also with that before."""
    # A list of one: its variable holds the tokens, so they are found once a text and not once a piece.
    tokens = F.array(F.regexp_extract_all(text, F.lit(f"(?:^[{SPACE}]+)?[^{SPACE}]++[{SPACE}]*+"), F.lit(0)))

    def cut(all_tokens: Column) -> Column:
        def words(p: Column) -> Column:
            return F.array_join(F.slice(all_tokens, (p["piece_from"] + 1).cast("int"), p["piece_words"].cast("int")), "")

        return F.transform(pieces, lambda p: p.withField("words", words(p)))

    return F.flatten(F.transform(tokens, cut))


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(row, doc: the whole input row, size, mark of its text), written: what is recomputed later finds the same row numbers."""
    size, mark = word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark")
    return durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"), size, mark), "mix-rows", "zstd")


def _buckets(numbers: DataFrame, bucket_rows: int) -> tuple[DataFrame, list[str]]:
    """numbers with columns that cut each source's rows into buckets of about bucket_rows rows, and the names of those columns.

    Rows go by id and text. A row repeated so often that it would be a bucket alone is parted by row number: its copies are
    alike, so it doesn't matter which stands where.
    """
    rows = numbers.count()
    buckets, most = max(1, -(-rows // bucket_rows)), max(bucket_rows, rows // MOST_REPEATED)
    same = ["source", "doc_id", "mark"]
    often = numbers.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    often = often.select(*(F.col(c).alias(f"_{c}") for c in same), F.ceil(F.col("_n") / most).alias("_parts"))  # at most MOST_REPEATED rows
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = numbers.join(F.broadcast(often), alike, "left")
    key = F.xxhash64("doc_id", "mark")
    parts = {
        "_bucket": F.pmod(key, F.lit(buckets)),
        "_often": F.when(F.col("_parts").isNotNull(), key).otherwise(0),
        "_part": F.coalesce(F.pmod(F.xxhash64("row"), F.col("_parts")), _none()),
    }
    return marked.withColumns(parts).select(*numbers.columns, *parts), [*parts]


def mix_pieces(
    rows: DataFrame, text: str = "text", seed: int = 11, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, DataFrame]:
    """rows: as _rows has them. Returns the plan by source (written) and the mix by pieces.

    Mix: (row, doc_id, source, rank, shard, slot, block, at, piece_from, piece_words, turn, words): the words of the row
    from word piece_from on, with their white space, stand in the slot in the order of `at`. turn: how many times they have
    been taken with this one.
    """
    numbers = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size", "mark")
    numbers, parts = _buckets(numbers, bucket_rows)
    summed = numbers.groupBy("source", *parts).agg(F.sum("size").alias("_sum"))
    plan = durable(source_plan(summed.groupBy("source").agg(F.sum("_sum").alias("source_size")), block_words=block_words), "mix-plan")
    before = W.partitionBy("source").orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    based = summed.withColumn("_base", F.coalesce(F.sum("_sum").over(before), _none())).alias("b")
    p = plan.alias("p")
    based = based.join(p, F.expr("b.source <=> p.source")).select("b.source", *parts, "_base", "rank")
    within = W.partitionBy("source", *parts).orderBy("doc_id", "size", "mark", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = numbers.withColumn("_start", F.sum("size").over(within) - F.col("size")).alias("r")
    same = " and ".join(f"r.{c} = b.{c}" for c in parts)
    placed = placed.join(based.alias("b"), F.expr(f"r.source <=> b.source and {same}"))
    placed = placed.select("row", "rank", "size", (F.col("_base") + F.col("_start")).alias("_from")).where("size > 0")

    first, last = F.floor(F.col("_from") / block_words), F.floor((F.col("_from") + F.col("size") - 1) / block_words)
    blocks = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_from"), F.col("block") * block_words)
    end = F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * block_words)
    blocks = blocks.select("row", "rank", "block", start.alias("at"), (start - F.col("_from")).alias("piece_from"), (end - start).alias("piece_words"))
    # The planner takes what is expanded for as small as what it expands from; it is never to be broadcast.
    taken = blocks.join(shard_slots(plan, seed, shard_blocks).hint("merge"), ["rank", "block"])
    turn = F.row_number().over(W.partitionBy("row", "piece_from").orderBy("shard", "slot"))  # at most MOST_REPEATS
    taken = taken.withColumn("turn", turn)
    own = F.struct("piece_from", "piece_words", "turn", "rank", "shard", "slot", "block", "at")
    lists = taken.groupBy("row").agg(F.collect_list(own).alias("_own"))  # of one text, by its length
    texts = rows.select("row", "doc.doc_id", "doc.source", F.col("doc").getField(text).alias("_text"))
    pieces = texts.join(lists.hint("shuffle_hash"), "row").withColumn("p", F.explode(words_of(F.col("_text"), F.col("_own"))))
    columns = ("rank", "shard", "slot", "block", "at", "piece_from", "piece_words", "turn", "words")
    return plan, pieces.select("row", "doc_id", "source", *(F.col(f"p.{c}") for c in columns))


def mix(docs: DataFrame, text: str = "text", seed: int = 11) -> DataFrame:
    """The mix by slots: (shard, slot, source, rank, block, pieces), slots gapless from 0 in each shard.

    pieces in order: (at, doc_id, piece_from, piece_words, words).
    """
    _, pieces = mix_pieces(_rows(docs.select("doc_id", "source", text), text), text, seed)
    return slots_of(pieces)


def slots_of(pieces: DataFrame) -> DataFrame:
    """The pieces of a mix gathered by slot."""
    own = F.struct("at", "row", "doc_id", "piece_from", "piece_words", "words")
    return pieces.groupBy("shard", "slot", "source", "rank", "block").agg(F.array_sort(F.collect_list(own)).alias("pieces"))  # at most block_words


def mix_report(docs: DataFrame, text: str = "text", seed: int = 11) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken (its words in the mix, repeats counted)."""
    rows = _rows(docs.select("doc_id", "source", text), text)
    plan, pieces = mix_pieces(rows, text, seed)
    taken = pieces.groupBy("row").agg(F.sum(word_count(F.col("words"))).alias("taken"))
    r = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size").join(taken.hint("merge"), "row", "left").alias("r")
    p = plan.alias("p")
    return r.join(p, F.expr("r.source <=> p.source")).select("doc_id", "size", "source_size", "target", F.coalesce("taken", _none()).alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", seed: int = 11) -> DataFrame:
    """The mix as documents: a row for each time (1 to 3) that words of a document are taken, with those words.

    White space between words taken together is kept; a document taken whole keeps its text as it is. n_chars, if
    there, counts the new text. All other columns stay as they are.
    """
    rows = _rows(docs, text)
    _, pieces = mix_pieces(rows, text, seed)
    taken = pieces.groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("piece_from", "words"))).alias("_own"))
    taken = taken.select("row", F.array_join("_own.words", "").alias("_mixed"))
    made = {text: F.col("_mixed"), "n_chars": F.length("_mixed").cast("long")}
    kept = [c for c in docs.columns if c not in made]
    wide = rows.select("row", F.struct(*(F.col("doc").getField(c).alias(c) for c in kept)).alias("doc")) if kept else rows.select("row")
    out = wide.join(taken.hint("merge"), "row")
    return out.select(*(made[c].alias(c) if c in made else F.col("doc").getField(c).alias(c) for c in docs.columns))
