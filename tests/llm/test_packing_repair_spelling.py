"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import conversations, packing, spelling
from quire.llm.catalog import QUERIES
from quire.llm.survivors import Survivors
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward_rows, frame

# -- packing ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return path, lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, texts, encode, capacity):
    """pieces: dicts with ids; texts: (doc_id, text). Every document is there whole, sequences have no gaps."""
    want = Counter()
    for i, t in texts:
        ids = encode(t)
        for k, p in enumerate(range(0, len(ids), capacity)):
            want[i, k, p, tuple(ids[p : p + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in pieces) == want
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packed_pieces_are_the_documents(spark, tokenizer, capacity):
    rows = awkward_rows() + [(900, "a\x0bb  c d <|endoftext|> e\x1cf \x85 Éá ΑΣ İ it's I'LL 12,5", None, None, None)]
    path, encode = tokenizer
    pieces, places = packing.pack_documents(frame(spark, rows, extra=True), path, capacity)
    got = [r.asDict() for r in pieces.join(places, "row").collect()]
    n = check_packing(got, [(r[0], r[1]) for r in rows], encode, capacity)
    total = sum(r["length"] for r in got)
    assert n <= -(-total // capacity) * 1.02 + 2
    whole = {r.sequence_id: r for r in packing.sequences(pieces, places).collect()}
    assert len(whole) == n and sum(r.length for r in whole.values()) == total
    for r in got[:50]:
        assert bytes(whole[r["sequence_id"]].ids)[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_placement_has_the_least_sum_of_squares():
    rng, capacity = np.random.default_rng(5), 40
    for _ in range(20):
        lengths = rng.integers(1, capacity + 1, 60)
        where, offset = packing.sum_of_squares(lengths, capacity)
        fill: dict[int, int] = {}

        def squares(f):
            return sum(n * n for g, n in Counter(capacity - x for x in f.values()).items() if g)

        for s, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
            assert o == fill.get(w, 0)
            room = [k for k, x in fill.items() if x + s <= capacity]
            if room:
                best = min(squares({**fill, k: fill[k] + s}) for k in room)
                assert w in fill and squares({**fill, w: o + s}) == best
            else:
                assert w not in fill
            fill[w] = o + s


def test_packing_over_groups_and_empty(spark, tokenizer, monkeypatch):
    path, encode = tokenizer
    monkeypatch.setattr(packing, "PIECES_PER_GROUP", 30)
    rows = awkward_rows()
    pieces, places = packing.pack_documents(frame(spark, rows), path, 64)
    got = [r.asDict() for r in pieces.join(places, "row").collect()]
    check_packing(got, [(r[0], r[1]) for r in rows], encode, 64)
    assert len({r["sequence_id"] >> 32 for r in got}) > 5
    pieces, places = packing.pack_documents(frame(spark, []), path)
    assert packing.piece_digests(pieces, places).count() == 0


def test_registered_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = QUERIES["op11_packing"](spark, SF_SMALL)
    longs = [(c, "bigint") for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), *longs]
    by = {(r.doc_id, r.piece): r for r in got.collect()}
    for d in docs[:40]:
        ids = tokenizer[1](d.text)
        for k, p in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[p : p + 4096], "<u4")
            assert (by[d.doc_id, k].start, by[d.doc_id, k].length, by[d.doc_id, k].ids_crc32) == (p, len(part), zlib.crc32(part.tobytes()))


# -- conversations ---------------------------------------------------------------------------

GOOD = re.compile("(s?(ua)+)?")


def fault_rows(rows):
    """(role, text, fault) after damage, in order: rows are (turn, role, text) sorted."""
    seen, out = set(), []
    for _, role, text in rows:
        tail = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_repairs(rows):
    """Every (cost, audit, repaired) with at most two rows inserted in a place."""
    ins = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def go(k):
        for add in ins:
            new = [(r, "") for r in add]
            if k == len(rows):
                yield 5 * len(add), "I" * len(add), new
                continue
            role, text, fault = rows[k]
            for cost, audit, rest in tails[k + 1]:
                yield 5 * len(add) + 2 + cost, "I" * len(add) + "D" + audit, new + rest
                if fault not in ("blank", "duplicate"):
                    more = 5 * len(add) + (5 if fault == "truncated" else 0)
                    yield more + cost, "I" * len(add) + "K" + audit, new + [(role, text)] + rest
                    for r in ("user", "assistant"):
                        yield more + 1 + cost, "I" * len(add) + "R" + audit, new + [(r, text)] + rest

    tails = {}
    for k in range(len(rows), -1, -1):
        # what ends in a legal string from any state is kept, the cheapest for each string of initials seen so far
        tails[k] = list(go(k))
        if k:
            best = {}
            for cost, audit, rest in tails[k]:
                word = "".join(r[:1] or "?" for r, _ in rest)
                if not re.fullmatch("s?(ua)*u?|a(ua)*u?|", word):
                    continue
                if cost <= 2 * len(rows) + 10:
                    best.setdefault((cost, audit, word), (cost, audit, rest))
            tails[k] = list(best.values())
    return tails[0]


def plain_repair(rows):
    faulty = fault_rows(rows)
    ok = [(c, a, rest) for c, a, rest in all_repairs(faulty) if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in rest))]
    cost, audit, rest = min(ok, key=lambda x: x[:2])
    text = "\n".join(f"{r}:{t}" for r, t in rest)
    kinds = Counter(f for *_, f in faulty)
    roles = [r[:1] for r, *_ in faulty]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    return (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(conv, turn, role, text):
    one = lambda x: " " if x is None else x
    kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
    role, text = one(role), one(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_report(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c] += damage(c, t, r, x)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plain_repair(sorted(v, key=order)) if v else empty for c, v in by.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]


def conversation_rows(seed, conversations_, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations_):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(ROLES) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "No!", "why?", "cut off", "", " \t", None, "a. ", f"row {t}.", f"open {t}"])
            turn = None if rng.random() < 0.1 else t + (3 if rng.random() < 0.1 else 0)
            rows.append((c, turn, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return [(None if c == 3 else c, t, r, x) for c, t, r, x in rows]


def report(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["segment", "fault", "copies", "audit", "first", "ck", "tk", "h1"])])
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversations.repair_report(df).collect()}


def test_repairs_are_the_cheapest(spark):
    rows = conversation_rows(1, 150, 5)
    assert report(spark, rows, extra=True) == plain_report(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_long_conversations_in_segments(spark, monkeypatch, size):
    """Segments of a row or three: the same edits as whole conversations (ties over many segments among them)."""
    rows = conversation_rows(2, 60, 9)
    whole = report(spark, rows)
    keep = conversations.segments
    monkeypatch.setattr(conversations, "segments", lambda turns: keep(turns, size))
    assert report(spark, rows) == whole


def test_survivors_keep_only_what_is_open():
    rng = random.Random(4)
    found, most = Survivors(0), 0

    def nodes():
        todo, n = [found.root], 0
        while todo:
            n += 1
            todo += todo.pop().kids
        return n

    rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 3])) for _ in range(3000)]
    for initial, fault in rows:
        found.step(conversations._TABLE[initial if initial in "sua" else "", fault])
        found.step(conversations.INSERTS, stay=True)
        conversations._prune(found)
        most = max(most, nodes())
    assert most < 200 and len(found.settled) > 2800


def test_ties_over_a_long_open_stretch():
    """Rows that fit no role from either state: both paths stay open, and the least string wins."""
    rows = [("x", 0, 1)] * 7
    got = conversations._search(rows, 0)
    cost = got.finish(conversations.ENDS)
    text = "".join(t for t, _ in got.settled)
    want = min((c, a) for c, a, rest in all_repairs([("x", f"{k}.", "") for k in range(7)]) if GOOD.fullmatch("".join(r[:1] for r, _ in rest)))
    assert (cost, text) == want


def test_dropped_and_empty_conversations(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None)]
    assert report(spark, rows) == plain_report(rows)
    assert report(spark, []) == {}


def test_registered_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversations"](spark, SF_SMALL)
    assert got.dtypes == [("conv_id", "bigint"), *[(f, "bigint") for f in FIELDS[:6]], ("audit", "string"), ("repaired_sha256", "string")]
    want = plain_report(rows)
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got.collect()} == want


# -- spelling --------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_spelling_against_all_pairs(spark):
    rng = random.Random(7)
    base = ["stone", "river", "answer", "élanée", "gardens", "lightest", "überall", "a" * 300, "abcdeabcde", "naïvement"]

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice("abcdeéüxyz")
        return rng.choice([w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[1:] + w[0]])

    rows = []
    for i in range(400):
        words = [typo(typo(rng.choice(base))) if rng.random() < 0.5 else rng.choice(base) for _ in range(30)]
        rows.append((i, rng.choice([" ", ", ", "-1"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += awk if (awk := [(r[0], r[1]) for r in awkward_rows()]) else []
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows], extra=True)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_spelling(rows)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200 and any(r != f and f for _, f, r, *_ in want)


def test_small_blocks_find_the_same(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(500)})
    df = spark.createDataFrame([(w, 3 + k % 5) for k, w in enumerate(words)], "word string, n long")
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    for groups, block in ((2, 7), (8, 1024), (3, 1)):
        got = [(r.word, r.near) for r in spelling.near_words(df, groups, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (None, "word word", None, None, None)])).count() == 0


def test_registered_spelling(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op13_spelling"](spark, SF_SMALL)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    found = {r.word: r for r in got.collect()}
    rng, n = random.Random(1), Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    assert {w: r.n for w, r in found.items()} == n
    for w in rng.sample(sorted(n), 150):
        near = [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        assert (found[w].n_near, found[w].form, found[w].form_n) == (len(near), form, n.get(form))
