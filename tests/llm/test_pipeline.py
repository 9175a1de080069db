"""The pipeline against a brute-force version of its decisions on a small corpus."""

import random

import corpus_pipeline
from ordeval.llm import mixing, neardup, pii, quality

from tests.llm.test_operators import brute_components, brute_spans, some_text, table


def corpus(spark, path):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(160):
        if i % 4 == 3:
            text = " ".join(f"{w.upper()}%%%" for w in some_text(rng, 70).split())
        elif i % 10 == 5:
            text = rows[i - 1][1] + " tail" if rows[i - 1][0] % 4 != 3 else some_text(rng, 20)
        else:
            text = some_text(rng, 70 + i % 30) + f" mail m{i}@x.org"
        rows.append((i, text, "en", rng.choice("aab")))
        labels.append((i, int(i % 4 != 3), 0))
    docs = table(spark, rows)
    docs.drop("size", "id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    path = str(tmp_path)
    rows = {r[0]: r for r in corpus(spark, path)}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, path)
        given.write.parquet(f"{path}/{name}")
        given = spark.read.parquet(f"{path}/{name}")
        if name != "pack":
            assert given.columns == docs.columns, name
        seen[name] = given.collect()
    good = {r["doc_id"] for r in seen["quality_rules"]}
    labelled_good = {i for i in rows if i % 4 != 3 and len(rows[i][1].split()) >= quality.MIN_WORDS}
    assert not any(i % 4 == 3 for i in good) and len(good & labelled_good) >= 0.97 * len(labelled_good)
    groups = brute_components([(i, rows[i][1]) for i in good], neardup.SHINGLE, neardup.THRESHOLD)
    assert {r["doc_id"] for r in seen["near_dedup"]} == {root for _, root in groups.values()}
    for r in seen["personal_data"]:
        text = rows[r["doc_id"]][1]
        assert r["text"] == pii.replaced(text, brute_spans(text)) and r["n_chars"] == len(r["text"])
    sizes, taken = {}, {}
    for r in seen["personal_data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in seen["mix_sources"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert abs(sum(taken.values()) - mixing.BUDGET * sum(sizes.values())) <= 2 * 102
    packed = seen["pack"]
    assert sum(r["n_words"] for r in packed) == sum(taken.values())
    assert len({(r["bin_id"], r["doc_id"]) for r in packed}) == len(packed)
    assert sorted(r["text"] for r in packed) == sorted(r["text"] for r in seen["mix_sources"])
    assert corpus_pipeline.run(spark, path).count() == len(packed)


def test_stages_on_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    rng = random.Random(22)
    texts = [some_text(rng, 60) + f" at 10.0.0.{i}" for i in range(12)]
    rows = [(i, x, "en", None if i % 3 else "a") for i, x in enumerate(texts)]
    rows += [(None, texts[0], "en", "a"), (None, some_text(rng, 70), "en", "b"), (3, texts[3], "en", None), (3, some_text(rng, 55), None, "a")]
    rows += [(50, None, "en", "a"), (51, "", "en", "a"), (52, "y " * 30000, "en", "a"), (53, some_text(rng, 9000), "en", "b"), (None, None, None, None)]
    docs = table(spark, rows).withColumnRenamed("size", "__id").withColumnRenamed("id", "found_hash")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, path)
        given.write.parquet(f"{path}/{name}")
        given = spark.read.parquet(f"{path}/{name}")
        assert name == "pack" or given.columns == docs.columns
        out[name] = given.collect()
        empty = stage(spark, docs.limit(0), path)
        assert empty.count() == 0 and set(empty.columns) == set(given.columns), name
    # without labels of both kinds the base rules decide: no words and repeated words go
    assert len(out["quality_rules"]) == 12 + 4 + 1
    # the copy under a null id and the repeated row go; a null id with a text of its own stays
    assert sorted(str(r["doc_id"]) for r in out["near_dedup"]) == sorted([*map(str, range(12)), "3", "53", "None"])
    assert all("10.0.0" not in r["text"] for r in out["personal_data"]) and len(out["personal_data"]) == 15
    assert sum(r["n_words"] for r in out["pack"]) == sum(len(r["text"].split()) for r in out["mix_sources"])
