import zlib
from collections import Counter

import corpus_pipeline
from public_tokenizers import path

from tabassay.llm import bpe, mixing, secrets, simhash, toxicity


def test_stages_against_their_parts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "best_fit_packing"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "source_mix", "best_fit_packing"]
    ids = lambda d: Counter(r["doc_id"] for r in d.select("doc_id").collect())
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(seen["toxicity"], labels).filter("predicted = 1").collect()}
    assert set(ids(seen["simhash_near_dedup"])) == set(ids(seen["toxicity"])) - toxic
    firsts = {r["component_id"] for r in simhash.near_duplicates(seen["simhash_near_dedup"]).collect()}
    assert set(ids(seen["secret_scans"])) == firsts
    before = {r["doc_id"]: r for r in secrets.scan_secrets(seen["secret_scans"]).collect()}
    for r in seen["source_mix"].collect():
        b = before[r["doc_id"]]
        assert (r["text"] == b["text"] and r["n_chars"] == b["n_chars"]) if not b["secrets"] else r["n_chars"] == len(r["text"]) and "[secret]" in r["text"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(seen["source_mix"]).collect()}
    assert ids(seen["best_fit_packing"]) == Counter({k: n for k, n in copies.items() if n})
    tokenizer = bpe.load(path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["best_fit_packing"].collect())
    packed = docs.collect()
    assert sum(r["length"] for r in packed) == want
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 2048
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in packed)
    assert corpus_pipeline.run(spark, sf_dir).columns == docs.columns


def test_every_stage_runs_once(spark, sf_dir, monkeypatch):
    """What a stage passes on is read from files: no plan reaches back beyond the stage before."""
    seen = []

    def watched(name, stage):
        def run(session, docs, folder):
            plan = docs._jdf.queryExecution().executedPlan().toString()
            seen.append((name, "MapInArrow" in plan or "Join" in plan, "Scan ExistingRDD" in plan))
            return stage(session, docs, folder)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [s[0] for s in seen] == ["toxicity", "simhash_near_dedup", "secret_scans", "source_mix", "best_fit_packing"]
    assert not any(s[1] for s in seen) and all(s[2] for s in seen[1:])


def test_registration():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    from helpers import docs, odd_texts

    texts = [*odd_texts(20_000), "token=abcdefgh1 here", "a b c d e", "a b c d e"]
    ids = [None, None, *range(len(texts) - 2)]
    odd = docs(spark, texts, ids, [None, "s", *["t"] * (len(texts) - 2)], clash=True)
    n_in = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, sf_dir)
            n = out.count()
            assert out.columns == odd.columns or name == "best_fit_packing"
            assert (n > 0) == (table is odd)
            if name in ("toxicity", "secret_scans") and table is odd:
                assert n == n_in
    masked = {(r["doc_id"], r["n_chars"], r["text"]) for r in corpus_pipeline.mask_secrets(spark, odd, sf_dir).collect() if "[secret]" in (r["text"] or "")}
    assert all(n == len(t) for _, n, t in masked) and len(masked) == 2
    same = docs(spark, [None, "x"], [1, 2]).withColumn("n_chars", __import__("pyspark").sql.functions.lit(7).cast("bigint"))
    assert [r["n_chars"] for r in corpus_pipeline.mask_secrets(spark, same, sf_dir).collect()] == [7, 7]
