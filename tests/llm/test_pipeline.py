"""The stages against brute force, each on what the one before kept."""

import corpus_pipeline
from tests.conftest import SF

from vellumlake.llm import omh, packing, pii, quality

from . import test_omh, test_packing, test_wumanber


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in kept.items() if "text" in v.columns}
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # quality: exactly the rows under the threshold, and labelled good rows stay
    whole = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert texts["quality_rules"].keys() == {r["doc_id"] for r in quality.scored(*whole).where("keep").collect()}
    good = {r["doc_id"] for r in whole[1].where("quality = 1").collect()} & start.keys()
    assert len(good & texts["quality_rules"].keys()) >= 0.97 * len(good)
    # near copies: one of each brute-force group of short texts
    rows = [(i, t) for i, t in texts["quality_rules"].items() if len(t) < 3000]
    for group in test_omh.brute_groups(rows, omh.SIMILARITY):
        assert len(texts["near_duplicates"].keys() & set(group)) <= 1
    lone = texts["quality_rules"].keys() - {r["doc_id"] for r in omh.near_duplicates(kept["quality_rules"]).collect()}
    assert lone <= texts["near_duplicates"].keys()
    # leaks: exactly those that brute force finds
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _, _ in test_wumanber.brute(texts["near_duplicates"].items(), items)}
    assert leaks and texts["decontamination"].keys() == texts["near_duplicates"].keys() - leaks
    # identifiers: no seed is left, all else is as it was
    assert texts["pii_masking"].keys() == texts["decontamination"].keys()
    hidden = 0
    for i, t in texts["pii_masking"].items():
        assert not [m for m in pii.mentions(t) if m[4]]
        hidden += t != texts["decontamination"][i]
    assert hidden and {r["n_chars"] == len(r["text"]) for r in kept["pii_masking"].collect()} == {True}
    # packing: every word once
    sizes = {i: len(t.split()) for i, t in texts["pii_masking"].items()}
    test_packing.check(kept["sequence_packing"].collect(), sizes, packing.CONTEXT)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(kept["sequence_packing"])
