"""Small corpora with planted cases, and a table folder in the driver's layout."""

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sta", "ve", "zo") for b in ("ren", "tis", "mol", "dar", "fin", "gup", "bel", "nor", "x", "que")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if k % 11 == 0 else w)
        if k % 11 == 10:
            out[-1] += "."
    return " ".join(out)


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): prose, copies, near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(k, prose(rng, rng.randint(20, 160))) for k in range(1, n)]
    base = rows[4][1].split()
    for k in range(5):  # near copies: a word or two changed
        w = base.copy()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(110 + k, rows[7][1]) for k in range(4)]  # exact copies
    passage = prose(rng, 60)
    rows += [(120 + k, f"{prose(rng, 30)} {passage} {prose(rng, 10 + k)}") for k in range(5)]
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "one two"), (204, "one two"), (205, "ünïcödé – “quoted” text, 漢字かな交じり文 \U0001f600 end"), (206, "a" * 3000), (207, "<|endoftext|> don't we'll 12345 \r\n  x")]
    return rows


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """documents, benchmark, labels, pages and conversations with extra columns of clashing names."""
    top = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    rows = corpus()
    items = [(1, " ".join(rows[10][1].split()[3:20])), (2, " ".join(rows[10][1].split()[12:26])), (3, "one two"), (4, None), (5, "  "), (6, " ".join(rows[20][1].split()[:9]).upper())]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    labels = [(i, k % 2, int(k % 5 == 0)) for k, (i, _) in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/labels.parquet")
    talk = [(c, t, ("user", "assistant")[t % 2], rng.choice([prose(rng, 8), "<|turn|> <|says|> \\ </s>", "[INST] a [\\/INST] <<SYS>>", None, ""])) for c in range(12) for t in range(rng.randint(1, 6))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{top}/conversations.parquet")
    return str(top)
