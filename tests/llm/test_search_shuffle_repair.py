"""Lexical search, external shuffle and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest_words import words

from quillon.llm import conversation_repair, external_shuffle, lexical_search
from quillon.llm._store import Workspace

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> dict:
    """Each item's (doc_id, score) by the formulas of the search's docstring."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, tokens = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for i, want in asked.items():
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // tokens
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if score > 0:
                found.append((d, score))
        out[i] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {i: x for i, x in out.items() if x}


ITEMS = [(1, "One two, THREE!"), (2, None), (None, "a b"), (None, "five"), (3, "zzz-unknown"), (4, ""), (5, "w1x1 w2x2 w3x3 one"), (6, "Ünïcode a, çŒ b")]


@pytest.mark.parametrize("chunk", [0, 2])
def test_search(spark, docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(lexical_search, "HELD", 2)
    base = [(r[0], r[1]) for r in rows] + [(70 + i, f"Ünïcode {'çŒ ' * i} five") for i in range(7)]
    items = ITEMS + [(9, " ".join(words(1, 20)))]
    table = docs.select("doc_id", "text", "host").unionByName(spark.createDataFrame([(d, t, "x") for d, t in base[len(rows) :]], "doc_id bigint, text string, host string"))
    got = lexical_search.search(spark, table, spark.createDataFrame(items, "item_id bigint, text string"), k=3, chunk=chunk).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(by[r.item_id])
    assert by == ranked(base, items, 3)


def test_search_prunes_blocks_without_loss(spark, monkeypatch):
    """Blocks of eight rows; few hold an item's rare terms."""
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    r = random.Random(5)
    base = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + (" rare" * r.randint(0, 2) if i % 37 == 0 else "")) for i in range(600)]
    items = [(i, " ".join(r.sample("abcdefgh", 3)) + " rare" * (i % 2)) for i in range(6)]
    got = lexical_search.search(spark, spark.createDataFrame(base, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = [(i, k + 1, d, s) for i, x in ranked(base, items, 10).items() for k, (d, s) in enumerate(x)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_stops_below_the_threshold():
    """A block whose bound is under a query's threshold isn't scored."""
    import numpy as np

    q = lexical_search.Queries(np.arange(1), np.zeros(1, np.int64), np.array([7]), np.array([100]), 10, 10)
    index = [lexical_search._index_batches]  # the real index rows, made of two texts
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["x x x", "x"])})
    (row,) = list(index[0](iter([batch])))
    b = lexical_search.Block(row, 0)
    q.terms = np.unique(b.terms)
    found = q.matches(b)
    assert q.bounds(*found[1:])[0] == q.scores(b, found, np.array([0])).max()
    best = lexical_search.Best(1, np.array([10**9]))
    best.take(b, np.array([0]), q.scores(b, found, np.array([0])))
    assert best.rows().num_rows == 0


def test_search_index_lies_in_small_pages(spark):
    """Blocks of some 100 KB: neither a row group nor a batch of the reader holds a file's blocks at once."""
    base = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 12000), x -> concat('d', id, 'w', x))) AS text").coalesce(1)
    work = Workspace(spark, "pages")
    assert lexical_search.write_index(work, base).count() == 50
    at = Path(work.path("index").removeprefix("file:"))
    for meta in (pq.ParquetFile(f).metadata for f in at.glob("*.parquet")):
        assert all(meta.row_group(i).total_byte_size < 12 << 20 for i in range(meta.num_row_groups))


def test_search_writes_merged_hits(spark, monkeypatch):
    """What is written are each query's best ten, not those of every task; blocks are read a few at a time."""
    written, read = {}, []

    def spy(self, df, name, *rest, write=Workspace.write):
        read.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        written[name] = write(self, df, name, *rest)
        return written[name]

    monkeypatch.setattr(Workspace, "write", spy)
    base = spark.range(400).selectExpr("id AS doc_id", "concat('one two w', id) AS text").repartition(4)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    got = lexical_search.search(spark, base, spark.createDataFrame([(1, "one"), (2, "two w7")], "item_id bigint, text string"))
    assert got.count() == written["hits-0"].count() == 20
    assert max(read) <= lexical_search.HELD and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before


def test_search_empty(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search(spark, none, items).count() == 0
    assert lexical_search.search(spark, docs, items.limit(0)).count() == 0


SHUFFLED = "doc_id bigint, text string, shard int, bucket string, place double, record int"


def shuffled(spark, df, tmp_path, name, shards=7, bucket=0):
    out = external_shuffle.write_shards(spark, df, f"file://{tmp_path}/{name}", shards, bucket=bucket)
    return [(r["shard"], r.slot, tuple(r.record)) for r in out.collect()]


def test_shuffle_keeps_rows_and_evens_counts(spark, tmp_path):
    base = [(i % 50, f"text {i % 90} " * (i % 7), i, "b", 0.5, None) for i in range(400)] + [(None, None, None, None, None, None)] * 5 + [(3, "", 1, "b", 1.0, 2)] * 2500
    df = spark.createDataFrame(base, SHUFFLED)
    got = shuffled(spark, df.repartition(3), tmp_path, "a", bucket=4000)
    assert Counter(x[2] for x in got) == Counter(base)
    by: dict = {}
    for shard, slot, _ in got:
        by.setdefault(shard, []).append(slot)
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # The same whatever the partitions are.
    assert sorted(got, key=str) == sorted(shuffled(spark, df.repartition(1), tmp_path, "b", bucket=4000), key=str)
    # A row that fills most of the table is in every shard by its share.
    share = Counter(s for s, _, r in got if r == (3, "", 1, "b", 1.0, 2))
    assert min(share.values()) > 300


def test_shuffle_mixes(spark, tmp_path):
    """Neighbours don't stay neighbours, and every shard gets ids of every stretch."""
    df = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text")
    got = shuffled(spark, df, tmp_path, "c", shards=4, bucket=20000)
    order = [r[0] for _, _, r in sorted(got)]
    assert sum(abs(a - b) < 80 for a, b in itertools.pairwise(order)) < 320
    for shard in range(4):
        ids = [r[0] // 1000 for s, _, r in got if s == shard]
        assert all(180 < n < 320 for n in Counter(ids).values())


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(external_shuffle.fisher_yates(4, [1, i]).tolist()) for i in range(24000))
    assert len(seen) == 24 and all(850 < n < 1150 for n in seen.values())
    assert external_shuffle.fisher_yates(1, [0]).tolist() == [0] and external_shuffle.fisher_yates(0, [0]).tolist() == []


def test_shuffle_few_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, None, None, None)], SHUFFLED)
    assert [x[:2] for x in shuffled(spark, df, tmp_path, "d")] == [(0, 0)]
    assert shuffled(spark, df.limit(0), tmp_path, "e") == []


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def sketch(rows: list[tuple]) -> list[tuple]:
    """Rows (turn, role, text) in order with their first fault."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for t, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def cheapest(rows: list[tuple]) -> tuple:
    """(cost, audit, lines) over all edits, with two inserts at a place at most."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    options = []
    for _, role, text, fault in rows:
        stays = 3 * (fault == "t")
        own = [(4, "D", None)] + ([] if fault in "bd" else [(stays, "K", (role, text))] + [(3 + stays, "R", (r, text)) for r in ("user", "assistant") if r != role])
        options.append([(c + 3 * len(g), "I" * len(g) + a, [(x, "") for x in g] + ([t] if t else [])) for g in gaps for c, a, t in own])
    options.append([(3 * len(g), "I" * len(g), [(x, "") for x in g]) for g in gaps])
    for choice in itertools.product(*options):
        turns = [t for _, _, ts in choice for t in ts]
        if LEGAL.match("".join(r[:1] or "-" for r, _ in turns)):
            new = sum(c for c, _, _ in choice), "".join(a for _, a, _ in choice), "\n".join(f"{r}:{t}" for r, t in turns)
            best = min(best, new) if best else new
    return best


def report(conv, rows: list[tuple]) -> tuple:
    if not rows:
        return conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    rows = sketch(rows)
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = Counter(f for *_, f in rows)
    illegal = sum((a[1][:1] or "-") + (b[1][:1] or "-") not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(rows)
    return conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, place int"


@pytest.mark.parametrize("block, fan", [(128, 64), (1, 2), (2, 3)])
def test_repair_is_the_cheapest(spark, block, fan, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "FAN", fan)
    r = random.Random(block)
    by: dict = {}
    for conv in [*range(40), None]:
        by[conv] = [(r.choice([0, 1, 2, 3, 5, None]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Yes.", "No", "", " \t", None, "So? ", "Ä!\n", "é"])) for _ in range(r.randint(1, 3))]
    by[77] = []
    rows = spark.createDataFrame([(c, *x, 9) for c, xs in by.items() for x in xs], CONVERSATIONS)
    ids = spark.createDataFrame([(c, 1) for c in by] * 2, "conv_id bigint, place int")
    got = conversation_repair.repair(spark, rows, ids)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((report(c, xs) for c, xs in by.items()), key=str)


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """Blocks multiplied in a tree give what one search over all rows gives."""
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["", "Yes.", f"no {t}", f"Row {t}."])) for t in range(300)]
    df = spark.createDataFrame([(*x, 1) for x in rows], CONVERSATIONS).union(spark.createDataFrame([(6, 1, "user", "Hi.", 1)], CONVERSATIONS))
    codes = "".join((role[0] if role[0] in "sua" else "-") + f for _, role, _, f in sketch([x[1:] for x in rows]))
    ((_, (cost, audit, _)),) = conversation_repair.shortest(codes, conversation_repair.START, True).items()
    monkeypatch.setattr(conversation_repair, "BLOCK", 4)
    monkeypatch.setattr(conversation_repair, "FAN", 4)
    got = {x.conv_id: x for x in conversation_repair.repair(spark, df).collect()}
    assert (got[5].cost, got[5].audit) == (cost, audit)
    assert (got[6].cost, got[6].audit) == (3, "KI")
    ordered, plans = conversation_repair.plan_repairs(Workspace(spark, "t"), df)
    turns = conversation_repair.repaired_turns(ordered, plans).where("conv_id = 5").orderBy("place").collect()
    assert LEGAL.match("".join(t.role[0] for x in turns for t in x.turns))


def test_repair_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([(1, None, "user", "Hi.", 0)] * 500, CONVERSATIONS)
    (row,) = conversation_repair.repair(spark, df).collect()
    assert (row.duplicate, row.gaps, row.illegal, row.cost, row.audit) == (499, 0, 499, 3 + 4 * 499, min("K" + "D" * 499 + "I", "K" + "I" + "D" * 499, "K" + "D" * 498 + "ID"))
    assert conversation_repair.repair(spark, df.limit(0)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b!") for c in [*range(30), None] for t in [0, 1, None]] + [(99, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = conversation_repair.damage(spark.createDataFrame([(*r, 1) for r in rows], CONVERSATIONS))
    assert Counter(map(tuple, got.collect())) == Counter(want)
