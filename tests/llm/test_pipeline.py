import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, prose  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng, 30))) for i in range(5)]
    passage = " ".join(prose(rng, 60))
    rows, labels, clean, gone = [], [], set(), set()
    for i in range(400):
        w = prose(rng, rng.randrange(40, 120))
        text = "\n".join([" ".join(w[:20]), " ".join(w[20:])])
        if i % 10 == 1:
            text = " ".join(x + "&&&" for x in w)
            gone.add(i)
        elif i % 10 == 2:
            text += "\n" + passage
            clean.add(i)
        elif i % 10 == 3:
            text = items[i % 5][1] + " " + text
            gone.add(i)
        elif i % 10 == 4:
            text = rows[i - 4][1].replace(" ", "  ")[:-1] + "x"  # all lines but the last are those of another text
            gone.add(i)
        elif i % 10 == 5:
            text = rows[i - 5][1]
            gone.add(i)
        else:
            clean.add(i)
        rows.append((i, text, f"s{i % 3}"))
        if i % 2 or i % 10 == 0:
            labels.append((i, int(i % 10 != 1), 0))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == clean and not gone & set(left)
    assert [i for i, t in left.items() if passage in t] == [2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == clean
    assert all(0 <= r.taken <= 2 * r.size for r in out) and sum(r.taken for r in out) > 0
