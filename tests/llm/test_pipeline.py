"""The pipeline end to end against plain stages: only the toxicity model, which is fitted, is taken from the operator."""

import random
from itertools import combinations

import corpus_pipeline
import pytest

from trackloom.llm import decontaminate, pieces, secrets, toxicity

from .test_decontaminate import slow as benchmark_hits
from .test_secrets import base
from .test_similar_texts import grams
from .test_simhash import roots


@pytest.fixture
def tables(spark, tmp_path):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([12, 30, 6])]
    docs, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        docs.append((i, prose(60) + (" idiot scum filth " * 4 if toxic else "") + prose(20)))
        if i < 120:
            labels.append((i, int(not toxic), int(toxic)))
    for i in range(10):  # near copies, of which the last links the first two
        w = docs[4 * i + 1][1].split()
        w[3:6] = ["x1", "x2", "x3"]
        docs.append((200 + i, " ".join(w)))
    docs += [(300 + i, prose(30) + " " + items[i % 3][1] + " " + prose(10)) for i in range(6)]
    docs += [(320, prose(30) + f" password = abcdef123 AKIA{'B' * 17} tail"), (321, prose(30) + " " + "0123456789abcdef" * 2), (330, None), (331, ""), (332, " ")]
    docs += [(5, docs[5][1]), (None, prose(40)), (340, docs[9][1].upper()), (341, "ü " * 3000)]
    full = [(i, t, "en", "s", len(t or ""), "extra") for i, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node__ string"
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, items


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"] and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_plain_stages(spark, tables):
    path, docs, items = tables
    table = spark.read.parquet(f"{path}/documents.parquet")
    chain = toxicity.fit(table, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(table, chain).where("toxic").collect()}
    assert {i for i in range(160) if i % 4 == 0} <= toxic and len(toxic) < 60
    kept = [(i, t) for i, t in docs if i not in toxic]

    sets = [grams(t) for _, t in kept]
    close = [(a, b) for a, b in combinations(range(len(kept)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first: dict = {}
    for k, of in roots(range(len(kept)), close).items():
        rank = lambda j: (kept[j][0] is None, kept[j][0] or 0)
        first[of] = min(first.get(of, k), k, key=rank)
    kept = [kept[k] for k in first.values()]
    kept = [(i, t) for i, t in kept if not benchmark_hits(t, items)[-1]]
    assert not {300, 301, 303} & {i for i, _ in kept} and 200 not in {i for i, _ in kept}

    want = {}
    for i, t in kept:
        t, at, out = t or "", 0, ""
        for s, _, e in base(t):
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, e)
        want[i] = out + t[at:]
    rows = corpus_pipeline.run(spark, path).collect()
    model = pieces.model(pieces.MODEL)
    assert {r["doc_id"]: model.decode(r["pieces"]) if r["pieces"] else "" for r in rows} == want
    assert len(rows) == len(want) and all(r["lossless"] for r in rows) and "[secret]" in want[320] and want[320].endswith(" tail")


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), path)
        assert empty.collect() == [] and [c for c in docs.columns if c != "node__"] == [c for c in empty.columns if c != "node__"], name


def test_operators_are_those_of_the_stages():
    assert corpus_pipeline.decontaminate is decontaminate and corpus_pipeline.secrets is secrets
