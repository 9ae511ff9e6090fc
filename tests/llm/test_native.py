"""Sharding, line dedup and mixing against brute force on awkward rows."""

from __future__ import annotations

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, sharding
from tests.llm.helpers import SCHEMA, awkward_rows, frame, rows_of, space_words


def test_shards_law_slots_and_growth(spark):
    rows = awkward_rows()
    df = frame(spark, rows, extra=True)
    got = sharding.shard_documents(df, 16).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr
    )
    by_key, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # what the grown shard says is what 17 shards give
    seventeen = {r.doc_id: r.shard for r in sharding.shard_documents(df, 17).collect()}
    assert all(seventeen[r.doc_id] == r.grown_shard for r in got)


def test_shards_follow_weights(spark):
    ids = spark.range(40_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 5.0])["shard"].alias("s"))
    n = {r.s: r["count"] for r in ids.groupBy("s").count().collect()}
    for s, share in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert abs(n[s] / 40_000 - share) < 0.015
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_hot_record_gets_gapless_slots(spark):
    df = frame(spark, [(1, "same", "en", "a", 1)] * 9000 + [(i, f"t{i}", "en", "a", 1) for i in range(500)])
    slots = collections.defaultdict(list)
    for r in sharding.shard_documents(df, 4).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 9500
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def water_fill(sizes: dict, share=1.5, epochs=2.0, cycle=(3, 1, 2)) -> dict:
    """Reshare the excess of capped sources by weight until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    cap = {s: epochs * n for s, n in sizes.items()}
    budget = share * sum(sizes.values())
    fixed: dict = {}
    while len(fixed) < len(order):
        rest = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        w = sum(weight[s] for s in rest)
        above = [s for s in rest if left * weight[s] / w >= cap[s]]
        if not above:
            return fixed | {s: left * weight[s] / w for s in rest}
        fixed |= {s: cap[s] for s in above}
    return fixed


def test_mix_targets_and_taken(spark):
    rows = awkward_rows()
    got = mixing.taken_words(mixing.plan_mix(frame(spark, rows, extra=True))).collect()
    sizes: dict = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(space_words(t))
    target = water_fill(sizes)
    taken: dict = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-9
    again = mixing.taken_words(mixing.plan_mix(frame(spark, rows[::-1]).repartition(5))).collect()
    key = lambda r: repr((r.doc_id, r.size, r.source, r.target, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_repeat_whole(spark):
    rows = awkward_rows()
    df = frame(spark, rows, extra=True)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    have = collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())
    words: dict = collections.Counter()
    sizes: dict = collections.Counter()
    for (_, t, s), n in have.items():
        sizes[s] += n * len(space_words(t))
    target = water_fill(sizes)
    for (i, t, s), n in collections.Counter((r.doc_id, r.text, r.source) for r in mixed.collect()).items():
        assert n <= 2 * have[i, t, s]
        words[s] += n * len(space_words(t))
    longest = {s: max(len(space_words(t)) for (_, t, x) in have if x == s) for s in sizes}
    for s in sizes:
        assert abs(words[s] - target[s]) <= longest[s] / 2 + 1


def test_lines_of_many_sites_go(spark):
    base = "Cookie notice\nunique {i}\n\n  Cookie notice \nshared by three"
    rows = [(i, base.format(i=i) if i % 2 else f"unique {i}\nCookie notice", "en", f"s{i % 7}", 1) for i in range(30)]
    rows += [(90, "local line\nlocal line", "en", "s0", 1)] * 20 + [(91, None, "en", None, 1), (92, "", "en", "s1", 1), (93, "Cookie notice", "en", None, 1)]
    df = frame(spark, rows, extra=True)
    got = {(r.doc_id, r.text, r.n_lines, r.removed_lines) for r in line_dedup.remove_boilerplate(df, "source", 5).collect()}
    sites = collections.defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(line_dedup.BLANKS)].add(s)
    expected = set()
    for i, t, _, _, _ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for x in lines if not (x.strip(line_dedup.BLANKS) and len(sites[x.strip(line_dedup.BLANKS)]) >= 5)]
        expected.add((i, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    assert got == expected


def test_far_lines_are_decided_by_the_sketch(spark):
    rows = [(i, f"everywhere\nsome {i % 50}", "en", f"s{i}", 1) for i in range(400)]
    lines = line_dedup.line_rows(frame(spark, rows), "source")
    # threshold 100: 400 sites lie far above the band, 8 far below; the sketch alone decides
    assert line_dedup.spread_lines(lines, 100).count() == 1
    assert line_dedup.spread_lines(lines, 8).count() == 51
    assert line_dedup.spread_lines(lines, 9).count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty, 16).count() == 0
    assert mixing.taken_words(mixing.plan_mix(empty)).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert line_dedup.remove_boilerplate(empty).count() == 0
    assert rows_of(mixing.source_targets(spark.createDataFrame([("a", 0)], "source string, source_size long"), 1.5, 2.0), "target") == [(0.0,)]
