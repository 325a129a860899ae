"""Small tables with the awkward cases that every operator must stand."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward():
    """Null, empty, blank, very long, repeated and odd texts; a repeated row."""
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split()
    near[100] = "changed"
    texts = [base, None, "", " \t\n ", base, " ".join(near), "one", "One", "Ünïcode tëxt 日本 \x00 end", words(rng, 9000), words(rng, 49), words(rng, 50)]
    texts += [words(rng, 30) + " " + base[: len(base) // 2] + " " + words(rng, 30), base.upper(), base.replace(" ", "\n\t")]
    texts += [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS)


def folder(spark, tmp, rows):
    """A folder with a documents table that has further columns of clashing names."""
    frame(spark, rows).selectExpr("*", "doc_id AS start", "text AS shard", "lang AS h", "source AS component").write.parquet(f"{tmp}/documents.parquet")
    return str(tmp)
