import re
import zlib
from collections import Counter, defaultdict

from caselens.llm import op1_sharding as slots, op8_mixing as mixing
from tests.llm.conftest import ODD


def check_shards(got, texts, shards):
    want = sorted((i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load = Counter({s: 0 for s in range(shards)})
    for r in got:
        load[r.shard] += r.size
    return load


def test_shards_hold_near_equal_bytes(documents, rows):
    got = slots.shard(documents, 8).collect()
    load = check_shards(got, [(r[0], r[1]) for r in rows], 8)
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())


def test_odd_rows_and_empty_tables(odd, empty):
    check_shards(slots.shard(odd, 3).collect(), [(r[0], r[1]) for r in ODD], 3)
    assert slots.shard(empty, 3).count() == 0


def test_rebalancing_moves_few_slots():
    current = slots.even_map(64, 4)
    size = [10] * 64
    assert slots.rebalanced(current, size, 4) == current
    size[0] = 100
    edited = slots.rebalanced(current, size, 4)
    assert sum(a != b for a, b in zip(current, edited)) <= 12
    load = [sum(b for b, s in zip(size, edited) if s == shard) for shard in range(4)]
    assert max(load) - min(load) <= 10


def test_map_versions_stay(spark, documents, tmp_path):
    slots.shard(documents, 4, slots=64, path=str(tmp_path / "map"))
    first, second = (slots.load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert [r.shard for r in first.orderBy("virtual_slot").collect()] == slots.even_map(64, 4)
    assert second.count() == 64


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(got, texts):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in texts)
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += words(t)
    target, taken, longest = brute_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == (r.copies or 0) * r.size and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)


def test_mix_meets_targets_and_repeats_itself(documents, rows):
    got = mixing.mix(documents).collect()
    check_mix(got, [(r[0], r[1], r[3]) for r in rows])
    again = mixing.mix(documents.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_mix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    texts = [(i, "w " * (1 + i * 7 % 23), "s" if i % 3 else "t") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(texts, "doc_id bigint, text string, source string")).collect()
    check_mix(got, texts)


def test_mix_expectation(spark):
    """Over many ids, equal documents of a source that gives half its words are taken half the time."""
    texts = [(i, "a b", "x") for i in range(4000)] + [(9000 + i, "a b", "y") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(texts, "doc_id bigint, text string, source string")).collect()
    early = [r.copies for r in got if r.doc_id < 2000]
    rate = next(r.target / r.source_size for r in got if r.source == "x")
    assert abs(sum(early) / len(early) - rate) < 0.05


def test_mix_of_odd_rows(odd, empty, spark):
    check_mix(mixing.mix(odd).collect(), [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.mix(empty).count() == 0
    mixed = mixing.repeated(odd)
    assert mixed.columns == odd.columns
    assert mixing.repeated(empty).count() == 0
