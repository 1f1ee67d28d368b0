from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm.secret_scan import REDACTED

SF = "/root/testdata/sf0.001"


def classes(texts, words=5, percent=80):
    """The smallest id that each text reaches over links, from all pairs."""
    sets, up = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in up}


def test_empty_table_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("lang is not null").limit(40)
    odd = some.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("digest", F.lit("x"))
    kept = corpus_pipeline.exact_dedup(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == kept.select(F.lower("text")).distinct().count() and kept.filter("doc_id is null").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_with_clashing_columns(spark):
    # Columns that bear the names that stages use inside come out as they were.
    names = ["__own_id", "__own", "__kept", "__digest", "__lost_id", "__language_rejected", "kept", "digest", "Path", "spans"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").limit(60)
    wide = docs.unionByName(docs.limit(5)).select("*", *[F.lit(f"{n} of a caller").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        assert out.select(*[f"`{n}`" for n in names]).distinct().collect() == [tuple(f"{n} of a caller" for n in names)], name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() >= 60


def test_stages(spark):
    from orrery.llm.scratch import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, texts = docs.columns, {r[0] for r in docs.select("doc_id").collect()}, dict(docs.select("doc_id", "text").collect())
    counts, before = [], texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        own = [r[0] for r in docs.select("doc_id").collect()]
        assert set(own) <= ids and len(own) == len(set(own))
        ids = set(own)
        counts.append(len(ids))
        now = dict(docs.select("doc_id", "text").collect())
        if name == "exact_dedup":
            winners = {}
            for i, t in before.items():
                key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
                winners[key] = max(winners.get(key, i), i)
            assert ids == set(winners.values())
        if name == "near_dedup":
            assert ids == {i for i, c in classes(before).items() if i == c}
        if name != "secret_scan":
            assert now == {i: before[i] for i in ids}
        else:
            changed = {i for i in ids if now[i] != before[i]}
            assert ids == set(before) and all(REDACTED in now[i] for i in changed)
            # What stays of a changed text stands in it, in order, between the cut-out values.
            for i in changed:
                assert re.fullmatch(".+?".join(map(re.escape, now[i].split(REDACTED))), before[i], re.DOTALL)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == ids
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
