"""Conversation repair, chunked encoding and the audit of sources against brute force and the libraries."""

import base64
import hashlib
import itertools
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from lexloom.llm import chunked_bpe, conversation, divergence, oracle, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]")
HASH = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    """Rows of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(own, key=key) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Every edit sequence of a short conversation whose result is a dialogue: (cost, audit, lines)."""
    marks = faults(rows)
    # no cheapest repair inserts more than two rows in one place: three lead where one does
    for places in itertools.product(*([["", "I", "II"]] * (len(rows) + 1))):
        for edits in itertools.product("DKR", repeat=len(rows)):
            audit = "".join(p + e for p, e in zip(places, [*edits, ""], strict=True))
            cost, lines, initials, i, ok = 0, [], "", 0, True
            for e in audit:
                wanted = "assistant" if initials.endswith("u") else "user"
                role, text = wanted, ""
                if e != "I":
                    role, text, mark = rows[i][1], rows[i][2], marks[i]
                    i += 1
                    if e == "D":
                        cost += 3
                        continue
                    ok &= mark not in ("blank", "duplicate") and (e == "R" or role != "")
                    cost += mark == "truncated"
                if e in "IR":
                    cost, role = cost + 2, wanted
                lines.append(f"{role}:{text}")
                initials += role[:1]
            if ok and re.fullmatch("(s?(ua)+)?", initials):
                yield cost, audit, lines


def expected(rows, cheapest):
    marks, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{m: marks.count(m) for m in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def random_rows(seed, convs, most):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        conv = None if c == 0 else c
        for t in range(r.randint(0, most)):
            turn = r.choice([t, t, t, t + 2, None])
            out.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), r.choice(["Yes.", "No.", "Why", "", None, " \t", f"Word {t}.", f"w{r.random()}! ", "é" * 70 + r.choice("ab.")])))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def repairs(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit("clash")).withColumn("cost", F.lit(7)).repartition(3)
    found = conversation.repair_damaged(df, **options).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}


def test_repairs_are_the_cheapest_of_all_edits(spark):
    rows = random_rows(3, 60, 4)
    want = {c: expected(own, min(all_repairs(own))) for c, own in damaged(rows).items()}
    assert repairs(spark, rows) == want
    assert {len(w["audit"]) for w in want.values()} >= {2, 4, 6} and sum(w["duplicate"] for w in want.values()) > 1


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_change_nothing(spark, block):
    rows = random_rows(4, 12, 25)
    assert repairs(spark, rows, block=block) == repairs(spark, rows)


def test_a_long_conversation_and_what_stands_in_it_earlier(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t % 400}.") for t in range(1500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = repairs(spark, rows)
    own = damaged(rows)[1]
    marks = faults(own)
    assert got[1]["duplicate"] == marks.count("duplicate") > 900
    # a walk that keeps the cheapest way to each state
    best = {0: (0, "")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    def added(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                best[nxt[s]] = min(best.get(nxt[s], (c + 2, a + "I")), (c + 2, a + "I"))
        return best

    for (_, role, _), mark in zip(own, marks, strict=True):
        new = {}
        for s, (c, a) in added(best).items():
            ways = [(s, c + 3, "D")]
            if mark in ("", "truncated"):
                c += mark == "truncated"
                ways += [(nxt[s], c + 2, "R"), *([(step[s, role[0]], c, "K")] if (s, role[0]) in step else [])]
            for t, cost, e in ways:
                new[t] = min(new.get(t, (cost, a + e)), (cost, a + e))
        best = new
    assert (got[1]["cost"], got[1]["audit"]) == min(w for s, w in added(best).items() if s in (0, 3))


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repairs(spark, [(gone, 0, "user", "Hi."), (gone, 0, "user", "Hi.")])
    assert got == {gone: dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": HASH}}
    assert conversation.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    far = repairs(spark, [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")])
    assert far[1]["audit"]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_source_divergence"])
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


def test_sql_has_the_same_defined_results(spark):
    rows = random_rows(9, 40, 6)
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = duck.sql(oracle.OP11)
    want = {r[0]: dict(zip(found.columns[1:], r[1:], strict=True)) for r in found.fetchall()}
    assert repairs(spark, rows) == want


# encoding


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(chunked_bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=chunked_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def encoded(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(16, 8), (64, 20), (1 << 14, 256)])
def test_chunks_give_the_ids_of_the_whole_text(spark, library, chunk, overlap):
    r = random.Random(8)
    parts = ["a", "'", "s", "l", " ", "  ", "\n", "1", "é", "ll", "'ll", " the", "!", "word", "\x1c", "日", "　", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 300))) for _ in range(150)]
    # runs longer than any overlap: chunks have nothing in common there
    texts += [None, "", " " * 500 + "x", "a" * 700, "1" * 300 + " \n" * 300 + "a" * 300 + "'ll" * 100, (" " * 60 + "a" * 60) * 6, "word " * 20_000, "\n" * 40_000 + "a" * 40_000]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, "again", "y"), (3, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string").withColumn("n_tokens", F.lit(0)).repartition(3)
    got = chunked_bpe.encode_decode(df, chunk=chunk, overlap=overlap).collect()
    assert Counter(map(tuple, got)) == Counter((i, *encoded(library, t)) for i, t, _ in rows)
    assert chunked_bpe.encode_decode(df.limit(0)).count() == 0


def test_overlaps_must_fit_into_chunks(spark):
    with pytest.raises(ValueError):
        chunked_bpe.encode_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), chunk=10, overlap=6)


def test_encoding_of_the_documents(spark, library):
    want = {r.doc_id: encoded(library, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_chunked_bpe"](spark, DATA).collect()} == want


# sources


def test_tries_hold_and_stream_their_terms():
    r = random.Random(2)
    terms = [bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    trie = divergence.Trie()
    for i in range(0, 3000, 500):
        part = terms[i : i + 500]
        x, y = Counter(part[:250]), Counter(part[250:])
        for t in set(part):
            trie.add(t, 1, [s for s, c in enumerate((x, y)) if c[t]], [c[t] for c in (x, y) if c[t]])
    leaves = list(trie.walk())
    assert [t for t, _ in leaves] == sorted(set(terms)) and trie.leaves == len(leaves)
    assert {t: sum(leaf.counts.values()) for t, leaf in leaves} == Counter(terms)


def test_merging_meets_equal_leaves_across_batches():
    r = random.Random(4)
    rows = sorted(("en" if r.random() < 0.7 else "de", r.choice(["a", "b", "bb", "é"]) + r.choice(["", "c"]), r.randint(1, 3), s := r.sample(["x", "y", "z"], r.randint(1, 3)), [r.randint(1, 9) for _ in s]) for _ in range(200))
    want = {}
    for lang, term, docs, sources, counts in rows:
        own = want.setdefault((lang, term), [0, Counter()])
        own[0] += docs
        own[1].update(dict(zip(sources, counts, strict=True)))
    for size in (1, 3, 50, 500):
        batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), divergence.LEAF_ARROW, strict=True)], schema=divergence.LEAF_ARROW) for i in range(0, len(rows), size)]
        got = [x for b in divergence._merge(15)(iter(batches)) for x in b.to_pylist()]
        assert {(x["lang"], x["term"]): [x["docs"], Counter(dict(zip(x["sources"], x["counts"], strict=True)))] for x in got} == {k: v for k, v in want.items() if v[0] >= 15}
        assert len(got) == len({(x["lang"], x["term"]) for x in got})


def brute_audit(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in terms}:
        own = [(s, w) for x, s, w in terms if x == lang]
        kept = [t for t, n in Counter(t for _, w in own for t in set(w)).items() if n >= least]
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if t in set(kept))
        whole = sum(counts.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            best = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, items in (("pair", pairs), ("term", best)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("leaves", [1, 10**6])
def test_audit_equals_brute_force(spark, monkeypatch, leaves):
    r = random.Random(6)
    words = ["The", "the", "ÉTÉ", "été", "Été", "a1b", "x", "日本", "\x7fzed", "it's", "ab", "abc", "abcd", "\U0001f600"]
    rows = [(None, None, None), ("", "en", "s1"), (None, "fr", "only"), ("alone alone", "de", "s1"), ("never kept", "pl", "s1"), ("one", "pl", "s2")]
    rows += [(" ".join(r.choice(words[: 6 + i % 9]) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s2", "", None, "é"])) for i in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit(1)).withColumn("term", F.lit("x")).repartition(3)
    monkeypatch.setattr(divergence, "GROUPS", 4)  # languages are walked in slices
    got = divergence.audit(df, least_docs=3, top=4, leaves=leaves)
    assert {tuple(x) for x in got.collect()} == brute_audit(rows, 3, 4) and got.count() == len(brute_audit(rows, 3, 4))
    assert divergence.audit(df.limit(0)).count() == 0


def test_a_language_of_too_many_sources_is_refused(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 2)
    with pytest.raises(ValueError):
        divergence.audit(spark.createDataFrame([("a", "en", str(i)) for i in range(3)], "text string, lang string, source string"))


def test_shares_are_exact_for_large_counts():
    import numpy as np

    counts = np.array([0, 7, 10**13, 4 * 10**15])
    total = int(counts.sum())
    assert divergence.share(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]
