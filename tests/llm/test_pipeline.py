import glob
import os

import corpus_pipeline as P
import pytest

from cotejo.llm import decontamination, near_duplicates
from cotejo.llm._common import table
from tests.llm.test_sharding import jump

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Every stage's rows, each written and read again as in a run."""
    base, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return base, out


def test_stages_keep_columns_and_take_effect(spark, kept):
    _, (source, lang, near, clean, mixed, sharded) = kept
    for df in (lang, near, clean, mixed):
        assert df.columns == source.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept[1]]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[3] == ids[4] == ids[5]
    assert len(ids[1]) >= 0.98 * len(ids[0])
    classes = near_duplicates.near_duplicate_classes(lang).collect()
    assert ids[2] == {r.component_id for r in classes}
    hits = decontamination.find_benchmark(near, table(spark, SF, "benchmark")).collect()
    assert ids[3] == {r.doc_id for r in hits if not r.contamination.hits}
    assert all(r.shard == jump(r.doc_id, 8) for r in sharded.collect())


def test_the_mix_is_the_order_of_the_files(spark, kept):
    base, (*_, clean, mixed, _) = kept
    from cotejo.llm import mixing

    keys = clean.select("doc_id", "source")
    plan = mixing.mix_sources(keys, ["doc_id"], "source", mixing.target_weights(keys, "source", P.MIX_POWER))
    want = [r.doc_id for r in plan.orderBy("position").collect()]
    files = sorted(glob.glob(os.path.join(base, "mixing", "part-*.parquet")))
    assert [r.doc_id for f in files for r in spark.read.parquet(f).select("doc_id").collect()] == want


def test_run_gives_the_last_stage(spark, kept):
    got = P.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "shard").collect())) == sorted(map(tuple, kept[1][-1].select("doc_id", "shard").collect()))


def test_the_mix_is_in_the_rows_of_a_run(spark, kept):
    from cotejo.llm import mixing

    keys = kept[1][3].select("doc_id", "source")
    plan = mixing.mix_sources(keys, ["doc_id"], "source", mixing.target_weights(keys, "source", P.MIX_POWER)).collect()
    rows = P.run(spark, SF).select("doc_id", "shard", "position", "within_target", "slot").collect()
    assert {r.doc_id: (r.position, r.within_target) for r in rows} == {r.doc_id: (r.position, r.within_target) for r in plan}
    assert len({r.shard for r in rows}) > 1
    for s in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.position)
        assert [r.slot for r in own] == list(range(len(own)))


def test_one_row_of_each_class_stays(spark, documents):
    prose = [" ".join(f"w{k}x{(i * 7) % 60}" for i in range(60)) for k in range(4)]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0]), (None, prose[0]), (None, prose[0])]
    rows += [(2, prose[1]), (None, prose[2]), (None, prose[2]), (7, prose[3] + " end"), (6, prose[3]), (9, None), (9, None), (8, "")]
    got = sorted(map(str, (tuple(r)[:2] for r in P.drop_near_duplicates(spark, documents(rows), SF).collect())))
    want = [(1, prose[0]), (2, prose[1]), (None, prose[2]), (6, prose[3]), (9, None), (9, None), (8, "")]
    assert got == sorted(map(str, want))
    assert P.drop_near_duplicates(spark, documents(rows).limit(0), SF).count() == 0


def test_no_two_rows_left_are_links(spark, kept):
    """Brute force over what the stage kept: no pair of similarity 0.8, and every class it saw has one row."""
    sets = {}
    for r in kept[1][2].select("doc_id", "text").collect():
        w = r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_contaminated_rows_against_brute_force(spark, kept):
    from tests.llm.test_decontamination import brute

    rows = lambda df: [(r[0], r[1]) for r in df.collect()]
    items = rows(table(spark, SF, "benchmark").select("item_id", "text"))
    near = rows(kept[1][2].select("doc_id", "text"))
    assert {r.doc_id for r in kept[1][3].collect()} == {i for i, _, hit, _ in brute(near, items) if not hit}


def test_a_run_leaves_only_what_its_result_reads(spark):
    from cotejo.llm._common import shared_dir

    had = set(os.listdir(shared_dir(spark)))
    P.run(spark, SF)
    new = {f for f in set(os.listdir(shared_dir(spark))) - had if f.startswith(("corpus-", "near-", "benchmark-"))}
    assert len(new) == 1 and new.pop().startswith("corpus-mixing")


def test_odd_rows_pass_through_every_stage(spark, documents, tmp_path):
    prose = "the and of with in that was on by for as are to his from it an were " * 6
    rows = [(1, prose), (1, prose), (2, None), (None, prose + "end of it all for now"), (4, ""), (5, prose + "x " * 20_000, None, None)]
    docs = documents(rows)
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        empty = stage(spark, documents(rows).limit(0), SF)
        assert empty.count() == 0
    # 2 and 4 hold no letters, 5 is mostly of one letter: no language
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    placed = P.mix(spark, documents(rows), SF)
    assert sorted(map(str, (r.doc_id for r in placed.collect()))) == sorted(str(r[0]) for r in rows)
