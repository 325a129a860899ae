"""The seam for models, with stubs."""

from passagekit.operators.models import answered, graded


def model(prompts):
    if "bad" in prompts:
        raise ValueError("no")
    return [p.upper() for p in prompts]


def test_failures_are_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, prompt string").coalesce(1)
    assert [(r.id, r.answer, r.error) for r in answered(df, "prompt", model).orderBy("id").collect()] == [(1, "A", None), (2, None, "ValueError: no"), (3, None, None)]


def test_grades(spark):
    df = spark.createDataFrame([(1, '{"score": 4}'), (2, "none"), (3, '{"score": 9}')], "id int, prompt string")
    assert [(r.id, r.score) for r in graded(df, "prompt", lambda ps: ps).orderBy("id").collect()] == [(1, 4), (2, None), (3, None)]
