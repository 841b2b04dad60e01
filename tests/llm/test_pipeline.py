import brute
import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq

from taperline.llm import bpe, queries, toxicity
from taperline.llm.stages import held_out


def test_run_against_brute_force(spark, data):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    rows = sorted(pq.read_table(f"{data}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    table = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    model = toxicity.fit_toxicity(table("documents"), table("labels").where(~held_out(5)))
    rows = [r for r in rows if model.score(*model.features(toxicity.words_of(r["text"] or ""))[:2]) < 0.5]
    sets = [brute.shingle_set(r["text"], 5) for r in rows]
    alike = lambda i, j: sets[i] == sets[j] or (min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    root = brute.groups(range(len(rows)), alike)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    raws = [(r["text"] or "").encode() for r in rows]
    for r, raw, flags in zip(rows, raws, brute.repeated(raws, 200, "first")):
        r["text"] = bytes(b for b, f in zip(raw, flags) if not f).decode(errors="ignore")
    items = [x["text"].lower().split() for x in pq.read_table(f"{data}/benchmark.parquet").to_pylist()]

    def leaks(text):
        a = text.lower().split()
        known = {w for b in items for w in b}
        if sum(w in known for w in a) < 8:
            return False
        at = {}
        for k, w in enumerate(a):
            at.setdefault(w, []).append(k)
        for b in items:
            places = {}
            for j, w in enumerate(b):
                for k in at.get(w, ()):
                    places[k - j] = places.get(k - j, 0) + 1
            for k, n in places.items():
                if n >= min(13, len(b)) and brute.best_stretch(a[max(k, 0) : k + len(b)], b[max(-k, 0) :])[1] >= min(13, len(b)):
                    return True
        return False

    rows = [r for r in rows if not leaks(r["text"])]
    assert set(got) == {r["doc_id"] for r in rows}
    made = bpe.MergeAutomaton.load(queries.vocabulary())
    for r in rows:
        x = got[r["doc_id"]]
        assert x["round_trip"] and x["text"] == r["text"] and bytes(x["ids"]) == made.encode(r["text"]) and x["n_tokens"] == len(np.frombuffer(x["ids"], "<u4"))


def test_stages_return_the_documents_columns(spark, data):
    from taperline.llm import stages

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
    assert stages.bpe(spark, docs.limit(0), data).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0, name
