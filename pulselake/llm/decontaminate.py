"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, id, pos) for every training word, where term is the word's XXH64. It is written once,
dealt by stretches of documents (the partitions of the input) and sorted by term within each, so a look-up of terms
reads few row groups of each stretch and building it shuffles nothing. Another benchmark is looked up in the same index.

Test items are cut into windows of 13 words (a shorter item is one window). Terms are ranked by their number of
postings; each window is looked up by its rarest positions: their postings, moved by the position in the item, must
meet on the same alignment of item and document (intersection of offset-adjusted lists). Alignments are then compared
word by word with the texts of the documents that have some, so two words of one hash make no hit.

The test side and the alignments are broadcast while their bytes, which are summed first, are within BROADCAST_BYTES; beyond
that the same joins shuffle.

Defined results: a null text has no words and no hits; an item without words has no window; rows with equal
ids are judged each on its own words; items with equal ids count each with its own windows and are one name in `items`;
null ids join like any other id, and a null item_id is an item whose name is null; an empty table on either side gives no hits; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.llm.common import ascii_lower, stored

WINDOW = 13
#: Positions of a window whose postings must meet before words are compared.
RAREST = 3
#: Bytes of the smaller side up to which a join broadcasts it.
BROADCAST_BYTES = 16 << 20
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text whose letters are not lower-cased.
APART_MIXED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART, -1), "")


def small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def test_items(tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, item_words, n, len (of its windows), row of each item that has words; row tells items with equal ids apart once this is stored."""
    items = tests.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
    items = items.withColumn("n", F.size("item_words")).where("n > 0")
    return items.withColumn("len", F.least(F.col("n"), F.lit(window))).withColumn("row", F.monotonically_increasing_id())


def term_of(word: Column) -> Column:
    return F.xxhash64(word)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, pos for each word of docs, written to the shared folder; sorted by term within each stretch of documents."""
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(words_of(F.col(text_col))).alias("pos", "word"))
    return stored(found.select(term_of(F.col("word")).alias("term"), "id", "pos").sortWithinPartitions("term"), "postings")


def rare_windows(items: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """items with windows: for each window that can occur, the offsets it is looked up by; items without such windows go."""
    placed = items.select("row", F.posexplode("item_words").alias("off", "word")).withColumn("term", term_of(F.col("word")))
    ranked = placed.join(counts, "term", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("off", "count"))).alias("placed_"))
    joined = items.join(ranked.select("row", F.transform("placed_", lambda p: p["count"]).alias("lengths")), "row")

    def looked_up(start: Column) -> Column:
        by_length = F.array_sort(F.transform(F.slice("lengths", start + 1, F.col("len")), lambda c, i: F.struct(c.alias("c"), (start + i).alias("o"))))
        known = F.forall(by_length, lambda s: s["c"].isNotNull())
        return F.when(known, F.transform(F.slice(by_length, 1, rarest), lambda s: s["o"]))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("len")), looked_up), lambda w: w.isNotNull())
    return joined.withColumn("windows", windows).where(F.size("windows") > 0).drop("lengths")


def alignments(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """id, row, shift, n: where all postings that some window is looked up by meet; item word o stands at shift + o. size: bytes of items."""
    offs = items.select("row", "item_words", F.explode(F.array_distinct(F.flatten("windows"))).alias("off"))
    offs = offs.select("row", "off", term_of(F.get("item_words", F.col("off"))).alias("term"))
    met = index.join(small(offs, size), "term").groupBy("id", "row", (F.col("pos") - F.col("off")).alias("shift")).agg(F.collect_set("off").alias("offs"))
    joined = met.join(small(items.select("row", "n", "windows"), size), "row")
    whole = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("offs"))) == 0)
    return joined.where(whole).select("id", "row", "shift", "n")


def hits_of(docs: DataFrame, found: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """id, sig, hits (positions of words in windows that occur), items (names, sorted) of the rows of docs (id, text, sig) that have some."""
    n_found = found.count()
    by_doc = found.groupBy("id").agg(F.collect_list(F.struct("row", "shift", "n")).alias("cands"))
    met = docs.alias("d").join(small(by_doc, 48 * n_found).alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")))
    met = met.select("d.id", "d.sig", words_of(F.col("d.text")).alias("words"), "c.cands")
    # Only the stretch that an alignment touches goes on with it.
    base = lambda c: F.greatest(c["shift"], F.lit(0))
    part = lambda c: F.slice("words", base(c) + 1, F.greatest(F.least(c["shift"] + c["n"], F.size("words")) - base(c), F.lit(0)))
    cut = met.select("id", "sig", F.explode(F.transform("cands", lambda c: F.struct(c["row"].alias("row"), c["shift"].alias("shift"), base(c).alias("base"), part(c).alias("part")))).alias("c"))
    cut = cut.select("id", "sig", "c.*").join(small(items.select("row", "item_id", "item_words", "n", "len"), size), "row")

    def same(o: Column) -> Column:
        at = F.col("shift") + o - F.col("base")
        inside = (at >= 0) & (at + F.col("len") <= F.size("part"))
        return F.when(inside, F.slice("part", at + 1, F.col("len")) == F.slice("item_words", o + 1, F.col("len"))).otherwise(False)

    cut = cut.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - F.col("len")), same)).where(F.size("starts") > 0)
    places = F.array_distinct(F.flatten(F.transform("starts", lambda o: F.sequence(F.col("shift") + o, F.col("shift") + o + F.col("len") - 1))))
    grouped = cut.select("id", "sig", F.col("item_id").cast("string").alias("item"), places.alias("places")).groupBy("id", "sig")
    return grouped.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"), F.transform(F.array_sort(F.collect_set(F.struct("item"))), lambda i: i["item"]).alias("items"))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """id, text, n_words, hits (positions of hit words), items (sorted as strings) of each row of docs. index: of the same docs, if there is one already.

    Use `verdict` for the counts.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = build_index(docs, id_col, text_col) if index is None else index
    items = stored(test_items(tests, item_col, item_text_col, window), "items")
    n, chars = items.agg(F.sum("n"), F.sum(F.octet_length(F.array_join("item_words", "")))).first()
    size = 64 * (n or 0) + (chars or 0)
    terms = items.select(F.explode("item_words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct()
    counts = stored(index.join(small(terms, size), "term").groupBy("term").count(), "term-counts")
    looked = stored(rare_windows(items, counts), "windows")
    found = stored(alignments(index, looked, size), "alignments")
    hits = stored(hits_of(read.withColumn("sig", F.xxhash64("text")), found, looked, size), "hits")
    n_bytes = hits.agg(F.sum(64 + 4 * F.size("hits") + 32 * F.size("items"))).first()[0] or 0
    sized = read.select("*", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), APART_MIXED, -1), "")).cast("long").alias("n_words"), F.xxhash64("text").alias("sig"))
    joined = sized.alias("d").join(small(hits, n_bytes).alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.sig") == F.col("h.sig")), "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return joined.select("d.id", "d.text", "n_words", F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("string")).alias("items"))


def verdict(judged: DataFrame, share: int = 20) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (1 / share of the words hit, and any)."""
    n_hit = F.size("hits").cast("long")
    return judged.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """id, phrase_id, pos: where all words of a phrase (phrase_id, terms) stand within `within` words of its rarest one.

    The rarest word's postings are joined with the others' on document and stretch of text, each
    stretch and its neighbours, so no list is paired with a whole other list. Words are told apart by their XXH64 here.
    """
    counts = index.groupBy("term").count()
    listed = F.array_distinct("terms")
    placed = phrases.select("phrase_id", F.explode(listed).alias("word"), F.size(listed).alias("n_terms")).withColumn("term", term_of(F.col("word")))
    ranked = placed.join(counts, "term").withColumn("r", F.row_number().over(W.partitionBy("phrase_id").orderBy("count", "word")))
    rare = ranked.where("r = 1").join(index, "term").select("phrase_id", "n_terms", "id", "pos")
    near = rare.select("*", F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("stretch"))
    others = placed.select("phrase_id", "term").join(index, "term").select(F.col("phrase_id").alias("o_phrase"), F.col("id").alias("o_id"), F.col("pos").alias("o_pos"), "term", F.floor(F.col("pos") / within).alias("o_stretch"))
    on = (F.col("phrase_id") == F.col("o_phrase")) & F.col("id").eqNullSafe(F.col("o_id")) & (F.col("stretch") == F.col("o_stretch")) & (F.abs(F.col("pos") - F.col("o_pos")) <= within)
    met = near.join(others, on).groupBy("id", "phrase_id", "pos", "n_terms").agg(F.count_distinct("term").alias("met"))
    return met.where("met = n_terms").select("id", "phrase_id", "pos")
