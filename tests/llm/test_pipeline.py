import bisect
import hashlib
import re
from collections import Counter

import corpus_pipeline
from matchloom.llm import decontamination, mixing, sharding, toxicity
from matchloom.llm.common import materialize, read_table
from tests.llm.test_mixing import water
from tests.llm.test_ngram_join import brute_force

SMALL = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = read_table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    model = toxicity.train(docs, read_table(spark, SMALL, "labels"))
    left = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in left.items() if i not in {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}}
    step = materialize(corpus_pipeline.drop_toxic(spark, docs, SMALL), "drop_toxic")
    assert {r.doc_id for r in step.collect()} == set(left)
    classes = {i: c for i, _, c in brute_force(left)}
    left = {i: t for i, t in left.items() if classes[i] == i}
    step = materialize(corpus_pipeline.drop_near_duplicates(spark, step, SMALL), "drop_near_duplicates")
    assert {r.doc_id for r in step.collect()} == set(left)
    items = [decontamination.normal_text(r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    step = materialize(corpus_pipeline.drop_contaminated(spark, step, SMALL), "drop_contaminated")
    assert {r.doc_id for r in step.collect()} == {i for i, t in left.items() if not any(x in decontamination.normal_text(t) for x in items)}
    kept = mixed_by_hand(step.collect(), corpus_pipeline.MIX_PERCENT)
    mixed = materialize(corpus_pipeline.mix(spark, step, SMALL), "mix")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == kept
    placed = materialize(corpus_pipeline.shard(spark, mixed, SMALL), "shard")
    assert placed.columns == [*docs.columns, "shard", "slot", "home_shard", "hops"]
    assert_poured(spark, mixed, placed.collect())
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in out) == Counter(kept) and len(out) > 50
    assert {(r.doc_id, r.home_shard) for r in out} == {(r.doc_id, r.home_shard) for r in placed.collect()}


def mixed_by_hand(rows, percent):
    """Ids of the documents that one epoch of the mix takes: budgets down the tree, then each leaf's prefix in seeded order."""
    leaves = {}
    for r in rows:
        number = re.search("[0-9]{1,9}$", r.source or "")
        key = (mixing.DOMAINS[int(number.group()) % len(mixing.DOMAINS)] if number else "other", r.lang or "", r.source or "")
        tokens = (len((r.text or "").encode()) + 3) // 4
        leaves.setdefault(key, []).append((hashlib.md5(f"{mixing.SEED}|0|{r.doc_id}".encode()).hexdigest(), r.doc_id, tokens))
    caps = {k: sum(t for *_, t in own) for k, own in leaves.items()}

    def below(budget, prefix):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({k[len(prefix)] for k in caps if k[: len(prefix)] == prefix and caps[k]})
        tables = (mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {})
        weights = {n: tables[len(prefix)].get(n, mixing.OTHER_WEIGHT if len(prefix) < 2 else mixing.SOURCE_WEIGHT) for n in names}
        shares = water(budget, {n: sum(c for k, c in caps.items() if k[: len(prefix) + 1] == (*prefix, n)) for n in names}, weights)
        return {k: b for n in names for k, b in below(shares[n], (*prefix, n)).items()}

    kept = set()
    for leaf, budget in below(sum(caps.values()) * percent // 100, ()).items():
        end = 0
        for _, doc, tokens in sorted(leaves[leaf]):
            end += tokens
            kept |= {doc} if end <= budget else set()
    return kept


def assert_poured(spark, docs, placed):
    """Every row at its ring home while there is room, the rows of an arc going on clockwise in rounds; slots gapless."""
    nodes = sharding.ring(sharding.SHARDS)
    cells = [c for c, _ in nodes]
    keyed = docs.selectExpr("doc_id", "shiftrightunsigned(xxhash64(0, doc_id), 32) as position").collect()
    arcs = {}
    for r in keyed:
        arcs.setdefault(bisect.bisect_left(cells, r.position >> 16) % len(nodes), []).append(r.doc_id)
    room = sharding.capacities(len(keyed), sharding.SHARDS)
    expected, waiting, hops = Counter(), {a: len(ids) for a, ids in arcs.items()}, 0
    while any(waiting.values()):
        for arc in sorted(waiting):
            shard = nodes[(arc + hops) % len(nodes)][1]
            n = min(waiting[arc], room[shard])
            room[shard] -= n
            waiting[arc] -= n
            expected[arc, shard, hops] += n
        hops += 1
    arc_of = {doc: a for a, ids in arcs.items() for doc in ids}
    assert Counter((arc_of[r.doc_id], r.shard, r.hops) for r in placed) == +expected
    assert all(r.home_shard == nodes[arc_of[r.doc_id]][1] for r in placed)
    for shard in range(sharding.SHARDS):
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))
