"""Each stage of the pipeline on its own input."""

import re
from collections import Counter

import corpus_pipeline
from dossier.llm import secrets, toxicity
from dossier.llm.sample import labelled


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = stage["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    model = toxicity.fit(labelled(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic"))
    import numpy as np

    clean = {i for i, t in texts.items() if model.score(np.array([toxicity.features(t, model.lexicon, model.learned)]))[0] < 0.3}
    assert {r.doc_id for r in kept.collect()} == clean

    single = stage["near_duplicates"](spark, docs, sf)
    assert single.columns == docs.columns

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[b] < group[a] and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a], changed = group[b], True
    assert {r.doc_id for r in single.collect()} == {i for i in group if group[i] == i}

    masked = stage["secrets"](spark, docs, sf)
    assert {r.doc_id: r.text for r in masked.collect()} == {i: secrets.mask(t) for i, t in texts.items()}

    mix = stage["mixing"](spark, docs, sf)
    assert mix.columns == docs.columns and max(Counter(r.doc_id for r in mix.collect()).values()) <= 2

    packed = stage["packing"](spark, docs, sf)
    assert sum(r.n_words for r in packed.collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts.values())
    assert corpus_pipeline.run(spark, sf).count() > 0
