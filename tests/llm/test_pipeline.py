"""The pipeline's stages end to end, each against plain Python on its own input, and edge cases of every stage."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from folio.llm import mixing, packing, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _same string, score string, _copy string"
SECRET = "token = 9f8A7sd6f5Q4w3e2R1t0"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = random.Random(6)
    lexicon = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 7))) for _ in range(600)]
    texts = [" ".join(r.choice(lexicon) for _ in range(r.randint(20, 120))) for _ in range(420)]
    bad = {k for k in range(420) if k % 6 == 0}
    texts = [t + " vilescum" * 3 if k in bad else t for k, t in enumerate(texts)]
    texts[401] = texts[1]  # exact and near copies
    texts[402] = texts[2].replace(texts[2].split()[8], "changed", 1)
    texts[5] += " " + SECRET
    texts[7] = None
    texts[11] = ""
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "i", "s", "0.9", "c") for k, t in enumerate(texts)]
    rows += [(1, texts[13] + " tail", "en", "s1", 5, "i", "s", "x", "c"), (None, texts[17], "en", "s1", 5, "i", "s", "x", "c"), rows[19]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k in bad)) for k in range(0, 420)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = out.collect()
        before, after = Counter(map(str, seen[list(seen)[-2]])), Counter(map(str, seen[name]))
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            model = toxicity.train(docs, labels)
            want = [x for x in seen["documents"] if model.score(toxicity.np.array([model.features(x["text"])]))[0] < 0.5]
            assert after == Counter(map(str, want)) and not any("vilescum" in (x["text"] or "") for x in want) and len(want) >= 340
        if name == "simhash_near_dedup":
            words = lambda t: (t or "").lower().split()
            sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(x["text"])) else frozenset() for x in seen["toxicity"]]
            root = list(range(len(sets)))
            for _ in range(4):
                for a in range(len(sets)):
                    for b in range(a):
                        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                            root[a] = root[b] = min(root[a], root[b])
            rows = seen["toxicity"]
            ids = {}
            for x, k in zip(rows, root):
                if x["doc_id"] is not None:
                    ids[k] = min(ids.get(k, 1 << 60), x["doc_id"])
            assert sorted(x["doc_id"] for x in seen[name] if x["doc_id"] is not None) == sorted(ids.values())
            assert sum(x["doc_id"] is None for x in seen[name]) == 1 and not after - before
        if name == "secret_scans":
            path = secrets.vocabulary_path()
            want = Counter(str((x["doc_id"], secrets.mask(x["text"], secrets.scan(x["text"], path)[1]) if x["text"] else x["text"])) for x in seen["simhash_near_dedup"])
            assert Counter(str((x["doc_id"], x["text"])) for x in seen[name]) == want and any(secrets.MASK in (x["text"] or "") for x in seen[name])
        if name == "source_mix":
            size, taken = Counter(), Counter()
            plan = {x["source"]: x["target"] for x in mixing.mix(docs).collect()}
            for x in seen["secret_scans"]:
                size[x["source"]] += len((x["text"] or "").split())
            for x in seen[name]:
                taken[x["source"]] += len((x["text"] or "").split())
            for s, target in plan.items():
                assert abs(taken[s] - target) <= 0.12 * size[s], (s, taken[s], target)
            assert set(after) <= set(before) and max(after.values()) <= 2
        if name == "best_fit_packing":
            encode = packing.Encoder.of(packing.vocabulary_path())
            want = Counter()
            for x in seen["source_mix"]:
                ids = encode(x["text"]) + (1).to_bytes(4, "little")
                for k in range(0, len(ids), 4 * packing.CAPACITY):
                    part = ids[k : k + 4 * packing.CAPACITY]
                    want[x["doc_id"], len(part) // 4, zlib.crc32(part)] += 1
            assert Counter((x["doc_id"], x["length"], x["ids_crc32"]) for x in seen[name]) == want
        docs = out
    again = corpus_pipeline.run(spark, folder).collect()
    key = lambda x: str((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]))
    assert Counter(map(key, again)) == Counter(map(key, seen["best_fit_packing"]))


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
