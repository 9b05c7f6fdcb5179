"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

The reference is the corpus itself, cut into blocks by word sequence: a block indexes the first place
(smallest document, then smallest position) of every word sequence of WINDOW words that falls to it. A
document is parsed greedily: a factor starts at the first position that some block knows from an earlier
document, and grows word by word while the reference's own words go on alike; the next factor starts at its end or
at the first known position after it. Factors of at least WINDOW words are duplicate spans; they do not overlap. A
sequence that runs over a factor's end can still be known from elsewhere, so the WINDOW - 1 positions before each
boundary are looked up too and give spans of their own.

Sending every position to its block would move eight bytes a word. So the blocks are asked in steps:

1. Seeds. Each window's smallest hash of SEED_WORDS consecutive words (its minimiser) is the same wherever
   the window stands. Documents send their distinct minimisers, about a fifth of the positions; blocks
   send back those that at least two documents hold. A window whose minimiser is not among them is unique.
2. Windows. Only positions with a shared minimiser are sent, as hashes of the whole window; blocks send
   back the reference place of those that at least two documents hold.
3. Words. Known positions that go on in one reference are a stretch. Its words, and up to REACH more where the
   reference may go on (an even earlier document names the next position), are sent to the group of documents that
   holds the reference, which compares them with the reference's words and answers how many are alike. So a chance
   collision of hashes never removes a word. A factor that is still alike after REACH words ends there and the next one starts.

Documents are dealt once to groups of bounded bytes by a hash of the id, in a bucketed table that all later
steps read without another shuffle; group numbers are picked so that each shuffle partition gets as many. A group
sends a block each distinct hash once, with its first document
in the group, and gets each answer once; it sends each distinct stretch to a reference once. So a passage that a third of all
documents hold costs a block, and the group of the reference, one entry for a group, and blocks and groups are even because
both are dealt by hashes. Hashes travel packed: one row for a group and a block, with numpy arrays inside.

Defined results: a null or empty text has no words and keeps none; rows with a null id are parsed as if no
document were before them and are no reference; rows with equal ids count as one document (neither is
earlier than the other), each parsed on its own; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import Ranges, Words, even_keys, mixed, partitions, sequence_hashes, shared_path, stored, text_blocks

WINDOW = 13
SEED_WORDS = 5
#: Bytes of text of a group of documents, and of hashes of a block, that are aimed at.
GROUP_BYTES = 64 << 20
#: Words that a stretch is compared beyond the positions its own reference was named for.
REACH = 64
_PACKED = "to int, frm int, hash binary, more binary"
#: What goes with a window's hash: the first document and position of it, and whether two documents hold it.
_PLACE = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("twice", "u1")])
_TWICE = np.dtype("u1")


def minimisers(hashes: np.ndarray, window: int = WINDOW, seed_words: int = SEED_WORDS) -> np.ndarray:
    """Of each window of words, the smallest hash of seed_words consecutive words."""
    seeds = sequence_hashes(hashes, seed_words)
    width = window - seed_words + 1
    n = len(seeds) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least, have = seeds, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def windows_of(first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the windows that lie within a text, where first is the first word of each text."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    return text, place


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def packed(frm: int, to: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> pa.Table:
    """A row for each receiver in `to`, which must be sorted."""
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
    ends = np.append(at, len(to))[1:]
    cut = lambda x: pa.array([_pack(x[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())
    return pa.table({"to": pa.array(to[at].astype(np.int32)), "frm": pa.array(np.full(len(at), frm, np.int32)), "hash": cut(hashes), "more": cut(more)})


def unpacked(rows: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sender, hash, more) of packed rows."""
    hashes = [np.zeros(0, np.uint64), *[_unpack(x.as_py(), np.uint64) for x in rows["hash"]]]
    more = [np.zeros(0, kind), *[_unpack(x.as_py(), kind) for x in rows["more"]]]
    frm = np.repeat(np.asarray(rows["frm"]), [len(h) for h in hashes[1:]])
    return frm, np.concatenate(hashes), np.concatenate(more)


def by_block(group: int, hashes: np.ndarray, more: np.ndarray, keys: np.ndarray) -> pa.Table:
    """What a group sends: sorted hashes, cut by the block they fall to; blocks have the numbers `keys`."""
    return packed(group, keys[((hashes >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64)], hashes, more)


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a document belongs to."""
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) * groups >> 32


def firsts(doc: np.ndarray, hashes: np.ndarray, pos: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, index of its hash for each row in that order, place of each distinct hash)."""
    order = np.lexsort((pos, doc, hashes))
    doc, h = doc[order], hashes[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    place = np.zeros(int(new.sum()), _PLACE)
    place["doc"], place["pos"] = doc[new], pos[order][new]
    place["twice"][run[doc != place["doc"][run]]] = 1
    if twice is not None:
        place["twice"][run[twice[order] > 0]] = 1
    return order, run, place


def shared_seeds(key: tuple, rows: pa.Table) -> pa.Table:
    """A block's answer to seeds: to each group those that at least two documents hold."""
    frm, h, twice = unpacked(rows, _TWICE)
    order, run, place = firsts(frm, h, np.zeros(len(h), np.uint8), twice)
    keep = order[place["twice"][run] > 0]
    keep = keep[np.argsort(frm[keep], kind="stable")]
    return packed(key[0].as_py(), frm[keep], h[keep], twice[keep])


def first_places(key: tuple, rows: pa.Table) -> pa.Table:
    """A block's answer to windows: to each group the first place of those that at least two documents hold."""
    frm, h, more = unpacked(rows, _PLACE)
    order, run, place = firsts(more["doc"], h, more["pos"], more["twice"])
    keep = place["twice"][run] > 0
    order, run = order[keep], run[keep]
    by = np.argsort(frm[order], kind="stable")
    return packed(key[0].as_py(), frm[order][by], h[order][by], place[run][by])


def _answers(rows: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(hash, more) that came back to a group, sorted by hash."""
    _, h, more = unpacked(rows, kind)
    order = np.argsort(h)
    return h[order], more[order]


#: Bits of a hash by which a table of marks tells most hashes that are not known.
_MARK_BITS = 22


def _marks(sorted_hashes: np.ndarray) -> np.ndarray:
    marks = np.zeros(1 << _MARK_BITS, bool)
    marks[sorted_hashes >> np.uint64(64 - _MARK_BITS)] = True
    return marks


def _found(sorted_hashes: np.ndarray, asked: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Index of each asked hash among sorted hashes, or -1. marks: those of the sorted hashes, which spare most searches."""
    out = np.full(len(asked), -1)
    if not len(sorted_hashes):
        return out
    some = np.arange(len(asked)) if marks is None else np.flatnonzero(marks[asked >> np.uint64(64 - _MARK_BITS)])
    at = np.minimum(np.searchsorted(sorted_hashes, asked[some]), len(sorted_hashes) - 1)
    out[some] = np.where(sorted_hashes[at] == asked[some], at, -1)
    return out


class Stretches:
    """Runs of known window positions of one text that go on in one reference: start, last (positions), ref_doc, ref_pos (of start), end (of the words to compare)."""

    def __init__(self, ref_doc: np.ndarray, ref_pos: np.ndarray, known: np.ndarray, window: int = WINDOW, reach: int = REACH):
        at = np.flatnonzero(known)
        self.window = window
        if not len(at):
            self.start = self.last = self.ref_doc = self.ref_pos = self.end = at
            return
        beside = at[1:] == at[:-1] + 1
        same = beside & (ref_doc[at[1:]] == ref_doc[at[:-1]]) & (ref_pos[at[1:]] == ref_pos[at[:-1]] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        self.start, self.last = at[first], at[np.append(first[1:], len(at)) - 1]
        self.ref_doc, self.ref_pos = ref_doc[self.start], ref_pos[self.start]
        closes = np.flatnonzero(np.append(~beside, True))
        run_end = at[closes[np.searchsorted(closes, first)]] + window
        # The next position's first document is later: this reference does not hold it, so it can't go on.
        on = np.append((self.start[1:] == self.last[:-1] + 1) & (self.ref_doc[1:] <= self.ref_doc[:-1]), False)
        self.end = np.where(on, np.minimum(self.last + window + reach, run_end), self.last + window)

    def keys(self, ranges: Ranges, low: int) -> np.ndarray:
        """A number for each stretch from its reference and words; ranges: of the block, low: the text's first word."""
        whole = ranges.hashes(self.start + low, self.end + low)
        return mixed(whole ^ mixed(self.ref_doc.astype(np.uint64)) + self.ref_pos.astype(np.uint64))

    def parse(self, alike: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
        """(factors, spans over their boundaries) as (start, words, ref_doc, ref_pos); alike: words of each stretch that its reference holds."""
        found, edges, at, window = [], [], 0, self.window
        starts, lasts, docs, places, alike = (x.tolist() for x in (self.start, self.last, self.ref_doc, self.ref_pos, alike))
        k, n = 0, len(starts)
        while k < n:
            at = max(at, starts[k])
            size = alike[k] - (at - starts[k])
            if at > lasts[k]:
                k += 1
                continue
            if size < window:
                at += 1
                continue
            found.append((at, size, docs[k], places[k] + at - starts[k]))
            end, j = at + size, k
            while j < n and starts[j] < end:
                low, high = max(starts[j], end - window + 1, at + 1), min(lasts[j], end - 1, starts[j] + alike[j] - window)
                if low <= high and not (j == k and high + window <= end):
                    edges.append((low, high - low + window, docs[j], places[j] + low - starts[j]))
                j += 1
            at = end
            while k < n and lasts[k] < at:
                k += 1
        return found, edges


def _sent(rows: list[tuple[int, int, int, bytes]]) -> tuple[bytes, bytes]:
    """Requests (key, ref_doc, ref_pos, words) as (hash, more) of a packed row."""
    keys, docs, places, words = zip(*rows, strict=True)
    head = [np.array([len(rows)], "<i8"), np.array(docs, "<i8"), np.array(places, "<i8"), np.array([len(w) for w in words], "<i8")]
    return _pack(np.array(keys, np.uint64)), zstandard.compress(b"".join([x.tobytes() for x in head] + list(words)), 1)


def _received(more: bytes) -> list[tuple[int, int, bytes]]:
    data = zstandard.decompress(more)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    docs, places, sizes = np.frombuffer(data, "<i8", 3 * n, 8).reshape(3, n)
    ends = (8 + 24 * n + np.cumsum(sizes)).tolist()
    return [(d, p, data[e - s : e]) for d, p, e, s in zip(docs.tolist(), places.tolist(), ends, sizes.tolist(), strict=True)]


def words_alike(words: bytes, text: bytes, at: int) -> int:
    """How many of the words (joined by one space) stand in text (the same, with a space at its end) from byte `at` on."""
    words += b" "
    if text.startswith(words, at):
        return words.count(b" ")
    n = min(len(words), len(text) - at)
    apart = np.flatnonzero(np.frombuffer(words, np.uint8, n) != np.frombuffer(text, np.uint8, n, at))
    return words.count(b" ", 0, int(apart[0]) if len(apart) else n)


def _texts(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(ids, null ids, words) of blocks of whole texts."""
    ids = rows.column(0).combine_chunks()
    null = np.asarray(ids.is_null())
    ids = np.asarray(ids.fill_null(0)).astype(np.int64)
    for low, high, data, offsets in text_blocks(rows.column(1)):
        yield ids[low:high], null[low:high], Words(data, offsets)


def _dealt(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """docs (id, text) with the number of their group, as a table bucketed by it. Null ids, which get no answers, are dealt in turn."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            to = np.where(np.asarray(ids.is_null()), np.arange(len(ids)) % len(keys), _group(np.asarray(ids.fill_null(0)).astype(np.int64), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[to].astype(np.int32)), ids, batch.column(1)], names=["to", "id", "text"])

    name, buckets = f"rlz_{uuid.uuid4().hex}", partitions(spark)
    dealt = docs.mapInArrow(run, "to int, id long, text string").repartition(buckets, "to")
    dealt.write.bucketBy(buckets, "to").sortBy("to").format("parquet").option("compression", "zstd").option("path", shared_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS, with_text: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans (start, words, ref_id, ref_start of each factor), edges (the same of what was found over the factors' ends) of each row of docs; with_text also kept."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Numbers of the groups of documents, which are those of the blocks too.
    keys = np.array(even_keys(docs.sparkSession, max(partitions(docs.sparkSession), size // group_bytes)), np.int64)

    def seeds(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["to"])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for ids, null, words in _texts(rows):
            text, place = windows_of(words.first, window)
            least = minimisers(words.hashes(), window, seed_words)[place]
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) if len(least) else np.zeros(0, bool)
            new &= ~null[text]
            found.append((ids[text[new]], least[new]))
        doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order, run, place = firsts(doc, h, np.zeros(len(h), np.uint8))
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
        return by_block(key[0].as_py(), h[order][new], place["twice"].copy(), keys)

    def asked(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["to"])
        shared, _ = _answers(answers, _TWICE)
        marks = _marks(shared)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
        for ids, null, words in _texts(rows):
            text, place = windows_of(words.first, window)
            hashes = words.hashes()
            ask = (_found(shared, minimisers(hashes, window, seed_words)[place], marks) >= 0) & ~null[text]
            text, place = text[ask], place[ask]
            found.append((ids[text], sequence_hashes(hashes, window)[place], (place - words.first[:-1][text]).astype(np.uint32)))
        doc, h, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order, run, place = firsts(doc, h, pos)
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
        return by_block(key[0].as_py() if key[0].is_valid else 0, h[order][new], place, keys)

    span = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())])

    def stretches(rows: pa.Table, places: pa.Table) -> Iterator[tuple]:
        """(id, null, n_words, words, Stretches, keys) of each text; words only where some position is known."""
        known, ref = _answers(places, _PLACE)
        marks = _marks(known)
        for ids, null, words in _texts(rows):
            hashes = words.hashes()
            at, data, ranges = _found(known, sequence_hashes(hashes, window), marks), words.data.tobytes(), Ranges(hashes)
            for d in range(len(ids)):
                low, high = int(words.first[d]), int(words.first[d + 1])
                here = at[low : max(low, high - window + 1)]
                parts = lambda d=d: data[words.offsets[d] : words.offsets[d + 1]].split()
                if null[d] or not (here >= 0).any():
                    yield ids[d], null[d], high - low, parts, None, None
                    continue
                place = ref[here]
                found = Stretches(place["doc"], place["pos"].astype(np.int64), (here >= 0) & (place["doc"] < ids[d]), window)
                yield ids[d], null[d], high - low, parts, found, found.keys(ranges, low)

    def asks_words(key: tuple, rows: pa.Table, places: pa.Table) -> pa.Table:
        to: dict[int, dict[int, tuple]] = {}
        for _, _, _, parts, found, names in stretches(rows.drop_columns(["to"]), places) if places.num_rows else ():
            if found is None or not len(found.start):
                continue
            split = parts()
            for k, name, group in zip(range(len(names)), names.tolist(), keys[_group(found.ref_doc, len(keys))].tolist(), strict=True):
                if name not in (sent := to.setdefault(group, {})):
                    sent[name] = (name, int(found.ref_doc[k]), int(found.ref_pos[k]), b" ".join(split[found.start[k] : found.end[k]]))
        cells = [_sent(list(sent.values())) for sent in to.values()]
        frm = np.full(len(to), key[0].as_py() if key[0].is_valid else 0, np.int32)
        return pa.table({"to": pa.array(list(to), pa.int32()), "frm": pa.array(frm), "hash": pa.array([c[0] for c in cells], pa.binary()), "more": pa.array([c[1] for c in cells], pa.binary())})

    def compared(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The answer of the group that holds the references: how many words of each stretch they hold."""
        asks = [_received(x.as_py()) for x in asked["more"]]
        of_doc: dict[int, list[tuple[int, int]]] = {}
        for i, found in enumerate(asks):
            for j, (doc, _, _) in enumerate(found):
                of_doc.setdefault(doc, []).append((i, j))
        alike = [np.zeros(len(found), np.uint32) for found in asks]
        for ids, null, words in _texts(rows.drop_columns(["to"])) if asks else ():
            data = words.data.tobytes()
            for d in range(len(ids)):
                if null[d] or (met := of_doc.get(int(ids[d]))) is None:
                    continue
                split = data[words.offsets[d] : words.offsets[d + 1]].split()
                text = b" ".join(split) + b" "
                starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])]).tolist()
                for i, j in met:
                    place = asks[i][j][1]
                    if place < len(split):
                        alike[i][j] = max(alike[i][j], words_alike(asks[i][j][2], text, starts[place]))
        more = [_pack(x) for x in alike]
        return pa.table({"to": asked["frm"], "frm": asked["to"], "hash": asked["hash"], "more": pa.chunked_array([pa.array(more, pa.binary())])})

    def parsed(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        kind = np.asarray(answers["kind"])
        places, lengths = answers.filter(pa.array(kind == 0)), answers.filter(pa.array(kind == 1))
        names, alike = _answers(lengths, np.dtype("<u4"))
        out: dict[str, list] = {"id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "edges": [], "kept": []}
        for ident, null, n, parts, found, asked_names in stretches(rows.drop_columns(["to"]), places):
            split, removed, factors, edges = parts(), 0, [], []
            if found is not None and len(found.start):
                at = _found(names, asked_names)
                factors, edges = found.parse(np.where(at >= 0, alike[at], 0).astype(np.int64))
                turns = np.zeros(n + 1, np.int64)
                spans = np.array(factors + edges, np.int64).reshape(-1, 4)
                np.add.at(turns, spans[:, 0], 1)
                np.add.at(turns, spans[:, 0] + spans[:, 1], -1)
                stays = np.cumsum(turns[:-1]) == 0
                removed = int(n - stays.sum())
                split = [w for w, s in zip(split, stays.tolist(), strict=True) if s]
            named = lambda spans: [dict(zip(("start", "words", "ref_id", "ref_start"), x, strict=True)) for x in spans]
            kept = b" ".join(split)
            row = (None if null else int(ident), n, removed, hashlib.sha256(kept).hexdigest(), named(factors), named(edges), kept.decode() if with_text else None)
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(span), "edges": pa.list_(span), "kept": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    dealt = _dealt(read, keys)
    of_group = dealt.groupBy("to")
    held = stored(of_group.applyInArrow(seeds, _PACKED).groupBy("to").applyInArrow(shared_seeds, _PACKED), "rlz-seeds")
    asks = of_group.cogroup(held.groupBy("to")).applyInArrow(asked, _PACKED)
    places = stored(asks.groupBy("to").applyInArrow(first_places, _PACKED), "rlz-places")
    words = of_group.cogroup(places.groupBy("to")).applyInArrow(asks_words, _PACKED)
    lengths = stored(of_group.cogroup(words.groupBy("to")).applyInArrow(compared, _PACKED), "rlz-lengths")
    answers = places.withColumn("kind", F.lit(0)).unionByName(lengths.withColumn("kind", F.lit(1)))
    spans = "array<struct<start: long, words: long, ref_id: long, ref_start: long>>"
    result = of_group.cogroup(answers.groupBy("to")).applyInArrow(parsed, f"id long, n_words long, n_removed long, kept_sha256 string, spans {spans}, edges {spans}, kept string")
    return result if with_text else result.drop("kept")
