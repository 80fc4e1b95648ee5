"""What a corpus teaches does not depend on its size, nor on how the words beside a name are written."""

from kennelflow.llm import personal


def taught(before: str) -> list[str]:
    return [f"Kept {before} Maria {n} today. Mail maria.{n.lower()}@mail.example for more." for n in ("Lopez", "Garcia", "Moreno", "Castro")]


def found_names(spark, texts: list[str]) -> set[str]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r.doc_id][r.start_pos : r.end_pos] for r in personal.personal_information(df).filter("kind = 'name'").collect()}


def test_a_rare_pattern_counts_in_a_large_corpus(spark):
    # 24,000 other pairs: a share of 1e-4 of their 48,000 edges is more than the 4 that the pattern has
    noise = ["there is a Blue Chair in it, " * 2000] * 12
    names = found_names(spark, [*taught("by warden"), "kept by warden maria lopez today", *noise])
    assert "maria lopez" in names and "Blue Chair" not in names


def test_a_pattern_beside_a_number_counts_in_lower_case(spark):
    # other words follow each name, so that only the number before it can tell
    texts = [t.replace(" today. Mail", f" {w}. Mail") for t, w in zip(taught("in room 12"), ("once", "twice", "never", "later"))]
    assert "maria lopez" in found_names(spark, [*texts, "kept in room 14 maria lopez yonder"])
