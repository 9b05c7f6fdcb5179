"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import registry
from pulselake.llm.common import Words, sequence_hashes, text_blocks

SPACE = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, word string, h1 long"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünd", "the", "THE", "of"]
    passage = " ".join(rng.choices(words, k=40))
    found: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "   \n \t"), (3, "one"), (4, "two words")]
    for i in range(5, 60):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 120)))
        if i % 3 == 0:
            text = f"{text} {passage} {rng.choice(words)}"
        if i % 4 == 0:
            text = text.replace(" w1 ", "\n  A Line that Repeats \n", 1) + "\nA line that repeats\nshort"
        found.append((i, text))
    found += [(60, found[10][1]), (61, found[10][1] + " more"), (62, " ".join(rng.choices(words, k=30_000)) + " " + passage)]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", (None, "a", "b", "c")[(i or 0) % 4] if i is None or i % 7 else "a", len(t or ""), 99, "k", "w", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts()).repartition(3).cache()


def test_words_and_hashes_follow_the_texts():
    import pyarrow as pa

    values = ["a bc  d", None, "", "\té e f\n", "bc d"]
    for _, _, data, offsets in text_blocks(pa.array(values)):
        words = Words(data, offsets)
        got = [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        assert got == [w for v in values for w in re.findall(SPACE, v or "")]
        h = words.hashes()
        assert len({*h.tolist()}) == len(set(got)) and h[1] == h[got.index("bc", 2)]
        pairs = sequence_hashes(h, 2)
        assert pairs[1] == pairs[len(got) - 2]


def substring_brute(rows, k=13):
    split = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - k + 1):
                first[tuple(w[p : p + k])] = min(first.get(tuple(w[p : p + k]), i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [[], [(None, "x " * 40), (None, None), (10, "w1 w2"), (70, "x " * 40)]])
def test_substring_dedup(spark, extra):
    from pulselake.llm.rlz import duplicate_spans

    rows = texts() + extra
    got = duplicate_spans(table(spark, rows), group_bytes=1 << 14, with_text=True)
    assert sorted([tuple(r)[:4] for r in got.drop("spans", "edges").collect()], key=str) == substring_brute(rows)


def test_substring_factors_are_greedy_disjoint_and_end_with_the_reference(spark, docs):
    from pulselake.llm.rlz import REACH, duplicate_spans

    split = {i: re.findall(SPACE, t or "") for i, t in texts()}
    seen, over = 0, 0
    for r in duplicate_spans(docs).collect():
        free = 0
        for s in r.spans:
            seen += 1
            assert s.words >= 13 and s.ref_id < r.id and s.start >= free
            ref, own = split[s.ref_id][s.ref_start :], split[r.id][s.start :]
            assert own[: s.words] == ref[: s.words]
            # The reference ends or differs there, unless the factor was cut after its reach.
            assert own[s.words : s.words + 1] != ref[s.words : s.words + 1] or not own[s.words :] or s.words >= 13 + REACH
            before = split[r.id][free : s.start + 12]
            for p in range(len(before) - 12):
                assert not any(before[p : p + 13] == w[q : q + 13] for i, w in split.items() if i < r.id for q in range(len(w) - 12) if w[q] == before[p])
            free = s.start + s.words
        for s in r.edges:
            over += 1
            assert s.words >= 13 and s.ref_id < r.id and split[r.id][s.start : s.start + s.words] == split[s.ref_id][s.ref_start : s.ref_start + s.words]
            assert any(f.start < s.start < f.start + f.words < s.start + s.words for f in r.spans)
    assert seen and over


def test_words_are_compared_whole():
    from pulselake.llm.rlz import words_alike

    assert [words_alike(w, b"ab cd ef ", 0) for w in (b"ab cd ef", b"ab", b"ab c", b"ab cd ef gh", b"x", b"ab cdx ef")] == [3, 1, 1, 3, 0, 1]
    assert words_alike(b"cd ef", b"ab cd ef ", 3) == 2 and words_alike(b"cd e", b"ab cd ef ", 3) == 1


def test_group_numbers_are_dealt_evenly(spark):
    from pulselake.llm.common import even_keys, partitions

    keys = even_keys(spark, 9)
    n = partitions(spark)
    dealt = spark.createDataFrame([(k,) for k in keys], "k int").groupBy(F.pmod(F.hash("k"), F.lit(n))).count().collect()
    assert len(set(keys)) == len(keys) >= 9 and {r["count"] for r in dealt} == {len(keys) // n} and len(dealt) == n


def line_brute(rows, least=10):
    return sorted(line_brute_rows(rows, least), key=str)


def line_brute_rows(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup(spark, batches):
    from pulselake.llm.line_runs import dedup_lines

    rows = texts() + [(None, "A line that repeats\nx"), (71, "É line that repeats\né line that repeats"), (72, "É line that repeats\n\n")]
    got = dedup_lines(table(spark, rows), batches=batches)
    assert got.columns[:9] == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted([(r.doc_id, r.n_lines_, r.n_dropped_, r.kept_) for r in got.collect()], key=str) == line_brute(rows)


def test_line_runs_are_levelled_and_sorted(spark, docs):
    from pulselake.llm.line_runs import LineStore, line_keys

    keys = line_keys(docs)
    store = LineStore(spark, fanout=2, buckets=2)
    for low in range(0, 63, 9):
        store.add(keys.where((F.col("id") >= low) & (F.col("id") < low + 9)))
    assert [len(level) for level in store.levels] == [1, 1, 1]
    firsts = store.firsts()
    assert firsts.count() == firsts.select("h1", "h2").distinct().count() == keys.select("h1", "h2").distinct().count()


def simhash_brute(rows, k=3):
    import xxhash

    prints = []
    for i, t in rows:
        w = re.findall(SPACE, (t or "").translate(LOWER))
        s = [" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
        count = Counter(b for x in s for b in range(64) if xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1)
        prints.append((i, sum(1 << b for b in range(64) if 2 * count[b] > len(s))))
    return prints


def linked_brute(prints):
    left = set(range(len(prints)))
    out = {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            at = todo.pop()
            group.add(at)
            near = {j for j in left if (prints[at][1] ^ prints[j][1]).bit_count() <= 3}
            left -= near
            todo += near
        least = min((prints[j][0] for j in group if prints[j][0] is not None), default=None)
        out.update({j: least for j in group})
    return sorted([(prints[j][0], prints[j][1], c) for j, c in out.items()], key=str)


def test_simhash(spark):
    from pulselake.llm.simhash import near_duplicates

    rows = texts() + [(None, "lonely text here"), (None, ""), (10, "w1 w2")]
    got = near_duplicates(table(spark, rows))
    assert sorted([(r.id, r.fp % 2**64, r.component_id) for r in got.collect()], key=str) == linked_brute(simhash_brute(rows))


@pytest.mark.parametrize("file_rows", [1, 4, 64])
def test_links_keep_components_whole(spark, file_rows):
    from pulselake.llm.simhash import components, links

    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for c in list(prints)[:6]:
        for _ in range(12):
            c ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
            prints.add(c)
    nodes = spark.createDataFrame([(x - (x >> 63 << 64),) for x in prints], "fp long")
    found = links(nodes, file_rows=file_rows)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in found.collect())
    root = {r.node: r.root for r in components(found).collect()}
    groups = defaultdict(set)
    for x in prints:
        s = x - (x >> 63 << 64)
        groups[root.get(s, s)].add(x)
    ordered = sorted(prints)
    want = defaultdict(set)
    for (i, _, c) in linked_brute(list(enumerate(ordered))):
        want[c].add(ordered[i])
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_links_broadcast_no_listed_rows(spark, monkeypatch):
    from pulselake.llm import simhash

    planned = []
    monkeypatch.setattr(simhash, "stored", lambda df, name, keep=simhash.stored: planned.append(df) or keep(df, name))
    nodes = spark.createDataFrame([(x,) for x in range(100)], "fp long")
    nodes = simhash.stored(nodes, "nodes")
    found = simhash.links(nodes)
    for df in [*planned[1:], found]:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert any("Generate" in line for line in lines)
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                at = line.index("BroadcastExchange")
                under = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-")) <= at), len(lines))]
                assert not any("Generate" in x for x in under)
    root = {r.node: r.root for r in simhash.components(found).collect()}
    assert root == dict.fromkeys(range(1, 100), 0)


def test_components_of_chains(spark):
    from pulselake.llm.simhash import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def hits_brute(rows, items, k=13):
    wins = set()
    for i, t in items:
        w = re.findall(WORD, (t or "").translate(LOWER))
        n = min(k, len(w))
        wins |= {(i, tuple(w[o : o + n])) for o in range(len(w) - n + 1) if n}
    out = []
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(LOWER))
        hit, found = set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_decontamination(spark, monkeypatch, bound):
    from pulselake.llm import decontaminate as d

    monkeypatch.setattr(d, "BROADCAST_BYTES", bound)
    rows = [r for r in texts() if r[0] != 62] + [(None, "nothing at all"), (80, "É-Ünd,the"), (81, "x." * 20)]
    items = [(1, texts()[9][1]), (2, None), (3, "..."), (4, "É ünd THE"), (5, "w5"), (10, texts()[9][1]), (5, "w5"), (6, "x " * 15), (7, "never seen before"), (1, texts()[12][1]), (None, texts()[15][1]), (None, "two words")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = d.verdict(d.decontaminate(table(spark, rows), tests))
    assert sorted(map(tuple, got.collect()), key=str) == hits_brute(rows, items)


def test_proximity_matches(spark, docs):
    from pulselake.llm.decontaminate import build_index, proximity_matches

    index = build_index(docs.where("doc_id < 30"))
    phrases = spark.createDataFrame([(1, ["w3", "w4"]), (2, ["w7", "w8", "w9"])], "phrase_id long, terms array<string>")
    got = {(r.id, r.phrase_id, r.pos) for r in proximity_matches(index, phrases, 6).collect()}
    count = Counter(w for i, t in texts() if i < 30 for w in re.findall(WORD, (t or "").translate(LOWER)))
    want = set()
    for pid, terms in ((1, ["w3", "w4"]), (2, ["w7", "w8", "w9"])):
        rare = min(terms, key=lambda x: (count[x], x))
        for i, t in texts()[:30]:
            w = re.findall(WORD, (t or "").translate(LOWER))
            want |= {(i, pid, p) for p, x in enumerate(w) if x == rare and all(any(w[q] == y for q in range(max(0, p - 6), min(len(w), p + 7))) for y in terms)}
    assert got == want and want


def test_mixture_meets_its_targets(spark, docs):
    from pulselake.llm.mixture import mix

    rows = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert Counter(r.id for r in rows) == Counter(i for i, _ in texts())
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            want.update({s: level * weight[s] for s in free})
            break
        for s in over:
            want[s] = 2 * sizes[s]
            rest -= want[s]
        free -= over
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=40)


def test_seats_go_to_the_highest_quotients(spark):
    from pulselake.llm.mixture import apportioned

    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 1.0, "e": 0.0, "f": 300.0}
    for seats in (0, 1, 7, 100):
        df = spark.createDataFrame([(1, p, v, seats, 75) for p, v in votes.items()], "g int, p string, v double, s long, m long")
        got = {r.p: r.quota for r in apportioned(df, ["g"], "p", "v", "s", "m").collect()}
        line = sorted(((-v / (2 * s + 1), p, s) for p, v in votes.items() if v for s in range(75)))[:seats]
        assert got == {p: sum(x[1] == p for x in line) for p in votes}


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    from pulselake.llm.token_counts import Counter as Tokens
    from pulselake.llm.token_counts import token_counts, tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    odd = [(80, "it's <|endoftext|>x <|startoftext|> I'LL don’t é ́a\x1cb\x85ÀÉ ΣΑΣ"), (81, "x" * 5000), (82, "日本語 １２３ $$$***"), (None, None)]
    rows = texts() + odd
    got = {r.doc_id: tuple(r)[1:] for r in token_counts(table(spark, rows), path).collect()}
    for i, t in rows:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    few = Tokens(path, remembered=10)
    assert few.count([t or "" for _, t in rows]) == [got[i][1] for i, _ in rows]


def test_token_counts_with_a_piece_model(spark, docs):
    import sentencepiece

    from pulselake.llm.token_counts import token_counts, tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs.where("doc_id < 20"), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in texts()[:20]}


def test_warc_round_trip(spark, tmp_path):
    from pulselake.llm.warc import page_of, read_warc, write_warc

    big, marked = "é" * 800, "x\r\n\r\nWARC/1.1\r\n\r\n" * 80
    pages = [(1, "http://a/1", big), (2, "http://a/ 2", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", marked), (9, "u", marked), (9, "u", marked), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        write_warc(df, path, compression=compression)
        rows = read_warc(spark, path).withColumn("page", page_of(F.col("record_id"))).withColumn("ref", page_of(F.col("refers_to"))).collect()
        got = sorted(((r.page, r.record_type, r.ref, r.payload_length, bytes(r.payload).decode()) for r in rows), key=str)
        want = []
        for i, _, html in pages:
            h = html or ""
            top = {big: 3, marked: 9}.get(h)
            again = i is not None and top is not None and i < top
            want.append((i, "revisit" if again else "response", top if again else None, len(h.encode()), "" if again else h))
        assert got == sorted(want, key=str)
        lean = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
        assert "PushedFilters: [EqualTo(record_type" in lean._jdf.queryExecution().toString() or lean.count() == 3
        assert all(r.payload is None and r.payload_digest.startswith("sha1:") for r in lean.collect())


def test_warc_reader_skips_what_is_not_wanted():
    import io

    from pulselake.llm.warc import _Stream, records

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            got = super().read(n)
            self.read_bytes += len(got)
            return got

    body = b"y" * 500_000
    one = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 500000\r\n\r\n" + body + b"\r\n\r\n"
    file = Counted(one.replace(b"%s", b"response") * 4 + one.replace(b"%s", b"metadata"))
    found = list(records(_Stream(file, False, 4096), lambda h: h["warc-type"] == "metadata"))
    assert [len(p) for _, p in found] == [500_000] and file.read_bytes < 600_000


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_ranges_give_each_record_once(spark, tmp_path, monkeypatch, compression):
    from pulselake.llm import warc

    # The writer's workers are forked with the module's own bounds; a partition's are planned here.
    monkeypatch.setattr(warc, "RANGE_BYTES", 150_000)
    rng = random.Random(3)
    pages = [(i, f"http://a/{i}", "".join(rng.choices("abcdefgh \r\n", k=rng.randrange(20_000)))) for i in range(300)]
    path = f"{tmp_path}/ranges"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, compression=compression)
    plan = warc.WarcReader({"path": path})
    parts = plan.partitions()
    assert len(parts) > 4
    rows = [r for p in parts for b in plan.read(p) for r in b.to_pylist()]
    assert sorted((r["record_id"], r["payload"].decode()) for r in rows) == sorted((f"<urn:page:{i}>", h) for i, _, h in pages)
    read = warc.read_warc(spark, path)
    assert read.count() == 300
    (tmp_path / "ranges" / "part-of-a-failed-task.warc").write_bytes(b"WARC/1.1 half")
    assert warc.read_warc(spark, path).count() == 300


def test_warc_does_not_inflate_what_is_not_wanted():
    import gzip
    import io

    from pulselake.llm.warc import member, members

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            got = super().read(n)
            self.read_bytes += len(got)
            return got

    noise = random.Random(1).randbytes(400_000)
    head = lambda kind: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 400000\r\n\r\n" % kind
    whole = b"".join(member(head(k), noise) for k in (b"response", b"metadata", b"response"))
    assert gzip.decompress(whole) == b"".join(head(k) + noise + b"\r\n\r\n" for k in (b"response", b"metadata", b"response"))
    file = Counted(whole)
    found = list(members(file, 0, len(whole), lambda h: h["warc-type"] == "metadata"))
    assert [p for _, p in found] == [noise] and file.read_bytes < 420_000
    file = Counted(whole)
    assert len(list(members(file, 0, len(whole), lambda h: True, False))) == 3 and file.read_bytes < 10_000


def test_warc_reads_archives_of_other_writers(spark, tmp_path):
    import gzip

    from pulselake.llm.warc import read_warc

    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(one % i) for i in range(3)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(one % i for i in range(3, 6))))
    (tmp_path / "c.warc").write_bytes(b"".join(one % i for i in range(6, 9)))
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got) == [f"<x:{i}>" for i in range(9)] and {bytes(r.payload) for r in got} == {b"hello"}


@pytest.mark.parametrize("dims", [3, 64])
def test_top_k_is_exact(spark, dims):
    from pulselake.llm.balltree import top_k

    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dims)]) for i in range(700)]
    rows += [(700 + i, rows[100][1]) for i in range(20)] + [(720, None), (721, [None] * dims), (722, [float("nan")] * dims), (723, [float("inf")] * dims), (724, [1.0]), (750, [1.0]), (None, [1.0] * dims), (800, [1e12] * dims), (850, [1e12] * dims)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0, shard_rows=100)
    good = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    good = [(i, x) for i, x in good if max(map(abs, x)) < 2**53]
    want = []
    for i, x in good:
        if i % 50 == 0:
            line = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in good if j != i and len(y) == len(x))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(line[:5]) if abs(s) < 2**63]
    got = [tuple(r) for r in got.collect()]
    keep = lambda rs: sorted(r for r in rs if r[0] not in (800, 850) and r[2] not in (800, 850))
    assert keep(got) == keep(want)


def test_ball_tree_prunes():
    from pulselake.llm.balltree import BallTree

    rng = np.random.default_rng(1)
    rows = np.repeat(rng.integers(-1000, 1000, (20, 8)), 200, axis=0) + rng.integers(-3, 4, (4000, 8))
    tree = BallTree(np.arange(4000), rows.copy(), leaf=64)
    q = rows[::400]
    scores, ids = tree.search(np.full(10, -1), q, np.full(10, np.iinfo(np.int64).min), 3)
    brute = q @ rows.T
    for i in range(10):
        line = sorted(range(4000), key=lambda j: (-brute[i, j], j))[:3]
        assert ids[i].tolist() == line and scores[i].tolist() == brute[i, line].tolist()


def test_toxicity_learns_words_and_their_variants(spark):
    from pulselake.llm.toxicity import Scorer, score, train, train_from

    rng = random.Random(2)
    plain = ["".join(rng.choices(["ta", "re", "mo", "li", "su", "ne", "ka"], k=rng.randrange(1, 5))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words.insert(rng.randrange(40), rng.choice(["blorbag", "frizzwit", "Zumpkin"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (900, "zumpkin")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    model = train_from(docs, known, F.col("doc_id") < 300)
    got = {(r.id, r.score) for r in score(docs, model).collect()}
    by_id = {i: s for i, s in got if i < 900}
    assert all((by_id[i] >= 0.3) == bool(y) for i, y in labels if i >= 300)
    assert min(by_id.values()) >= min(s for i, s in got if i == 901) >= 0
    p = lambda t: model.probability(Scorer(model).margin([t])[0])
    assert min(p("a blor-bag"), p("frizz.wit here"), p("z u m p k i n")) > 0.3 > p(" ".join(plain[:50]))
    assert p("x" * 5000 + "frizzwit") >= 0 and train(["a", "b"], [0, 0], 0.0).probability(3.0) == 0.0


def test_secret_scan(spark):
    from pulselake.llm.secrets import candidates, redacted, scan

    rng = random.Random(8)
    rows, want = [], set()
    for i in range(60):
        hexes = "".join(rng.choices("0123456789abcdef", k=40))
        key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
        rows.append((3 * i, f'some words token = "{hexes}" and more words'))
        rows.append((3 * i + 1, f"the key {key} is here, theandthethingthatthere stands"))
        rows.append((3 * i + 2, f"a number {rng.randrange(10**15, 10**16)} and thingsthatareordinary see http://host/some-long-path-name"))
        want |= {hexes, key}
    docs = spark.createDataFrame([*rows, (None, None), (200, "")], "doc_id long, text string")
    got = scan(docs)
    assert {r.value for r in got.where("is_secret").collect()} == want
    assert got.count() == candidates(docs).count() > len(want)
    clean = redacted(docs, got)
    assert clean.count() == docs.count() and not clean.where("text rlike 'AKIA'").count()
    assert scan(docs.where("doc_id % 3 = 2")).where("is_secret").count() == 0


def test_secret_scan_takes_every_run_of_a_word(spark):
    from pulselake.llm.secrets import candidates, redacted, scan

    rng = random.Random(9)
    made = lambda n: "a7" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows, want = [], defaultdict(set)
    for i in range(40):
        a, b, c, d, e, f, g, h = (made(n) for n in (38, 30, 30, 24, 24, 34, 60, 40))
        rows.append((4 * i, f"run with AWS_SECRET_ACCESS_KEY={a} set"))
        rows.append((4 * i + 1, f'reply {{"access_token":"{b}","refresh_token":"{c}"}} was sent'))
        rows.append((4 * i + 2, f"open https://host/login?access_token={d}&refresh_token={e} and theandthethingthatthere"))
        rows.append((4 * i + 3, f"call with eyJ{f}.eyJ{g}.{h} or go to thingsthatareordinary"))
        for k, found in enumerate(({a}, {b, c}, {d, e}, {f"eyJ{f}", f"eyJ{g}", h})):
            want[4 * i + k] |= found
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    got = scan(docs)
    found = defaultdict(set)
    for r in got.where("is_secret").collect():
        found[r.id].add(r.value)
    assert found == want
    assert got.select("id", "at", "place").distinct().count() == got.count()
    names = {r.value for r in candidates(docs).where("id = 0").collect()}
    assert "AWS_SECRET_ACCESS_KEY" in names
    for r in redacted(docs, got).where("doc_id is not null").collect():
        assert not any(v in r.text for v in want[r.doc_id])


def test_secret_scan_takes_whole_values(spark):
    from pulselake.llm.secrets import candidates, redacted, scan

    rng = random.Random(10)
    short = lambda: "".join(rng.choices("abcdefghkmnpqrstuvwxyzABCDEFGH", k=5)) + rng.choice("&!$~.") + "".join(rng.choices("23456789", k=3)) + "xQ"
    rows, want = [], {}
    for i in range(30):
        for form in ('set password = "{}" here', "login with password={} or ask", "the pwd: {} for all", '{{"user":"bob","password":"{}","n":3}}', "get https://bob:{}@host/x now", "db_password='{}', then"):
            rows.append((len(rows), form.format(value := short())))
            want[rows[-1][0]] = value
        rows.append((len(rows), "the author wrote of thingsthatareordinary and tokens of love"))
    rows += [(1000, 'password = "hunter2Abc9" end hunter2Abc9x'), (1001, 'password="Tr0ub4dor&3x"'), (1002, 'password: "two words\n4 you" end')]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    found = {(r.id, r.value) for r in candidates(docs).collect()}
    assert set(want.items()) | {(1000, "hunter2Abc9"), (1001, "Tr0ub4dor&3x"), (1002, "two words 4 you")} <= found
    got = scan(docs)
    secrets = {(r.id, r.value) for r in got.where("is_secret").collect()}
    assert set(want.items()) | {(1000, "hunter2Abc9"), (1001, "Tr0ub4dor&3x")} == {x for x in secrets if x[0] != 1002}
    assert got.select("id", "at", "place").distinct().count() == got.count()
    clean = {r.doc_id: r.text for r in redacted(docs, got, mark="[$1]").collect()}
    assert all(v not in clean[i] for i, v in want.items()) and clean[1000] == 'password = "[$1]" end hunter2Abc9x'
    taken = spark.createDataFrame([(1002, "two words 4 you", True)], "id long, value string, is_secret boolean")
    assert redacted(docs.where("doc_id = 1002"), taken).first().text == 'password: "[SECRET]" end'


def test_planted_findings_are_told_apart(spark, docs):
    """Trained on four fifths of the planted findings, judged on the rest: other values, the same kinds of text."""
    from pulselake.llm import secrets

    texts, labels = secrets.planted(docs, 4)
    made = {r.id: (r.text, r.label, r.value) for r in texts.join(labels, "id").collect()}
    assert len(made) == 4 * len(secrets.MADE) and all(v and v in t and "!" not in t.replace(v, "") for t, _, v in made.values())
    assert len({v for _, y, v in made.values() if y}) == sum(1 for _, y, _ in made.values() if y)
    rows = secrets.planted_rows(docs, ["the", "was", "for"], 20).cache()
    assert rows.where("label = 1").select("id").distinct().count() == 20 * sum(y for y, _ in secrets.MADE)
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    model = secrets.fit(rows.where(~held).drop("id"))
    out = secrets.judged(rows.where(held), model).select("label", (F.col("score") >= 0.5).alias("out")).collect()
    hit, wrong = sum(r.label == 1 and r.out for r in out), sum(r.label == 0 and r.out for r in out)
    assert hit >= 0.9 * sum(r.label == 1 for r in out) and wrong <= 0.1 * sum(r.label == 0 for r in out)


EMPTY = {"documents": DOCS, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}


def test_every_query_takes_empty_tables(spark, tmp_path):
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from pulselake.llm.common import stored

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for at, (name, stage) in enumerate(p.STAGES):
        docs = stored(stage(spark, docs, sf), "t")
        assert at + 1 == len(p.STAGES) or docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    assert sorted(map(str, docs.collect())) == sorted(map(str, p.run(spark, sf).collect()))


#: Columns that the operators use inside, next to those of `documents`.
CLASHING = ["id", "sig", "fp", "pos", "row", "hits", "items", "drops", "lines_", "left_", "gone_", "kept_", "n_lines_", "n_dropped_", "score_", "l_id", "y", "toxic_", "kept_id", "dirty_id", "place_", "late_", "id_", "sig_", "root", "size", "digest", "shard", "n_words", "words"]


def toxic_rows():
    rng = random.Random(21)
    plain = ["".join(rng.choices(["ta", "re", "mo", "li", "su", "ne", "ka"], k=rng.randrange(1, 5))) for _ in range(300)]
    rows = texts()[:60] + [(None, "A line that repeats\nno id here at all"), (None, None), (None, "A line that repeats\nno id here at all"), (7, texts()[7][1]), (7, "another text of seven"), (2, "  ")]
    labels = []
    for i in range(100, 260):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["blorbag", "frizzwit", "zumpkin"]))
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(i % 4 == 0)))
    return rows, [*labels, (None, 1, 1), (200, 1, None)]


@pytest.mark.parametrize("empty", [(), ("documents", "labels", "benchmark"), ("benchmark",), ("labels",)])
def test_pipeline_equals_brute_force(spark, tmp_path, empty):
    """Each stage against plain Python (the last against SQL), on nulls, repeated ids and rows, empty tables and columns of clashing names."""
    import duckdb

    import corpus_pipeline as p
    from pulselake.llm import oracles
    from pulselake.llm.common import stored
    from pulselake.llm.toxicity import Scorer, train_from

    rows, labels = toxic_rows()
    items = [(1, texts()[9][1]), (1, "w5 w6 w7"), (2, None), (None, "another text of seven")]
    sources = [None, "a", "b", "c"]
    full = [(i, t, "en", sources[0 if i is None else i % 4], len(t or "")) for i, t in rows]
    made = {
        "documents": (spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long"), "documents"),
        "labels": (spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels"),
        "benchmark": (spark.createDataFrame(items, "item_id long, text string"), "benchmark"),
    }
    for name, (df, _) in made.items():
        df = df.limit(0) if name in empty else df
        if name == "documents":
            df = df.select("*", *[F.lit(c).alias(c) for c in CLASHING])
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = train_from(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = Scorer(model)
    at = [(r.doc_id, r.text) for r in docs.collect()]
    tests = [] if "benchmark" in empty else items

    def near(pairs):
        prints = simhash_brute(pairs)
        groups = defaultdict(list)
        left = set(range(len(pairs)))
        while left:
            todo, group = [left.pop()], []
            while todo:
                j = todo.pop()
                group.append(j)
                close = {k for k in left if (prints[j][1] ^ prints[k][1]).bit_count() <= 3}
                left -= close
                todo += close
            groups[min(group)] = group
        return groups

    wants = {
        "toxicity": lambda pairs: sorted(((i, t) for i, t in pairs if model.probability(scorer.margin([t or ""])[0]) < p.REJECTED), key=str),
        "line dedup": lambda pairs: sorted(((i, r[3] if r[2] else t) for (i, t), r in zip(pairs, line_brute_rows(pairs), strict=True)), key=str),
        "decontamination": lambda pairs: sorted(((i, t) for i, t in pairs if not hits_brute([(i, t)], tests)[0][2]), key=str),
    }
    for name, stage in p.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "t")
        assert docs.columns == columns, name
        assert not docs.select(*[c for c in CLASHING]).distinct().where(" or ".join(f"{c} <> '{c}'" for c in CLASHING)).count(), name
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "near dedup":
            groups = near(at)
            assert len(got) == len(groups)
            for group in groups.values():
                ids = [at[j][0] for j in group if at[j][0] is not None]
                kept = [x for x in got if x in [at[j] for j in group]]
                assert kept and kept[0][0] == (min(ids) if ids else None)
        else:
            assert got == wants[name](at), name
        at = [(r.doc_id, r.text) for r in docs.collect()]
    last = p.STAGES[-1][1](spark, docs, sf).collect()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({oracles.OP9}) WHERE taken > 0").fetchall()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in last), key=str) == sorted(((*r[:3], round(r[3], 6), r[4]) for r in want), key=str)
    assert sorted(map(str, p.run(spark, sf).collect())) == sorted(map(str, last))


def test_operators_take_columns_of_any_name(spark, docs):
    from pulselake.llm.line_runs import dedup_lines
    from pulselake.llm.toxicity import score, train_from

    more = docs.select("*", *[F.lit(c).alias(c) for c in CLASHING if c not in docs.columns])
    assert sorted((r.doc_id, r.kept_) for r in dedup_lines(more).collect()) == sorted((r.doc_id, r.kept_) for r in dedup_lines(docs).collect())
    labels = spark.createDataFrame([(i, i % 2, 5, 6) for i in range(40)], "doc_id long, toxic int, l_id int, y int")
    a, b = (sorted((r.id, r.score) for r in score(x, train_from(x, labels)).collect()) for x in (more, docs))
    assert a == b


def test_shared_files_are_few_and_checked(spark):
    """No file of checksums beside a stored one (each starts a process), a damaged page is refused, and a small run is written by one task."""
    import glob
    import os

    from py4j.protocol import Py4JJavaError

    from pulselake.llm.common import partitions, stored
    from pulselake.llm.line_runs import LineStore, line_keys

    rows = spark.range(2000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    back = stored(rows, "checked")
    assert sorted(back.collect()) == sorted(rows.collect())
    (part,) = [f.removeprefix("file://") for f in back.inputFiles()]
    assert not glob.glob(f"{os.path.dirname(part)}/.*.crc")
    with open(part, "r+b") as file:
        file.seek(os.path.getsize(part) // 3)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Py4JJavaError, match="FAILED_READ_FILE"):
        back.agg(F.sum(F.length("s")), F.sum("id")).collect()
    store = LineStore(spark, tasks=1)
    store.add(line_keys(spark.createDataFrame([(i, f"some line of number {i}") for i in range(200)], "doc_id long, text string")))
    (run,) = store.runs()
    assert run.count() == 200
    files = [f.removeprefix("file://") for f in run.inputFiles()]
    assert len(files) == partitions(spark) and {os.path.basename(f)[:10] for f in files} == {"part-00000"}
    assert not glob.glob(f"{os.path.dirname(files[0])}/.*.crc")
