import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty texts, ties, repeated rows, near copies, a long text and a column with a clashing name."""
    base = [f"w{i}" for i in range(60)]
    texts = {
        1: " ".join(base),
        2: " ".join(base),
        3: " ".join(base[:58]) + " other words",
        4: " ".join(base[:30]),
        5: None,
        6: "",
        7: "one two three",
        8: "ONE two\tthree",
        9: " \n ",
        10: " ".join(f"x{i % 700}y{i // 700}" for i in range(9000)),
        11: "é" * 5000,
        12: "é" * 5000 + "e",
    }
    clash = ("clash",) * 6
    rows = [(k, t, "en", None, None, *clash) for k, t in texts.items()]
    rows += [(7, "one two three", "en", None, None, *clash), (None, "one two three", *(None,) * 9)]
    return spark.createDataFrame(rows, DOC + ", row string, name string, kept string, _language string, score string, component_id string")
