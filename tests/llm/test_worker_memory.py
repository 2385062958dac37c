import gc
from types import SimpleNamespace

from pyspark.sql import functions as F

from faultline.llm import common, langid


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back_to_the_system():
    blocks = [bytes(100_000) for _ in range(3000)]
    pins = [bytes(100_000) for _ in range(2)]  # on top of the heap
    full = resident()
    del blocks
    common.release()
    assert full - resident() > 200_000_000 and pins


def test_every_task_releases_its_memory(spark, tmp_path):
    """The worker's collector is one that leaves a file behind, once."""
    mark = str(tmp_path / "released")

    def work(ids):
        def collect():
            open(mark, "w").close()
            common.gc = gc

        common.gc = SimpleNamespace(collect=collect)
        return [ids]

    df = spark.range(3)
    assert common.map_texts(df, [F.col("id")], work, "id long").count() == 3
    assert (tmp_path / "released").exists()


def test_filter_by_language_equals_the_labels_of_the_texts(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "", None, "12 34"] * 3
    model = langid.fit([t for t in texts[:3] for _ in range(4)], ["en", "de", "fr"] * 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    lab = langid.Labeller(model)
    want = {i for i, t in enumerate(texts) if (x := lab.documents([t or ""])[0])[0] != langid.UNKNOWN and x[1] >= langid.MIN_SCORE}
    assert {r.doc_id for r in langid.keep_identified(df, model).collect()} == want
    assert langid.keep_identified(df, None).count() == 0
