import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and odd texts, copies, near copies, repeated rows, hot lines and a clashing column."""
    base = [f"w{(k * 7919) % 523}x{k % 11}" for k in range(400)]
    near = base.copy()
    near[200] = "changed"
    line = "A common line that many documents have"
    texts = {
        0: " ".join(base), 1: " ".join(base), 2: " ".join(near), 3: None, 4: "", 5: "   \n\t", 6: "one two three", 7: "One  TWO three", 8: f"{line}\nfirst own line of eight\nshort",
        9: f"  {line.upper()}\t\nsecond own line of nine", 10: f"third\n{line}", 11: "é ñ ü " * 120, 12: "ab" * 400, 13: "aaaa", 14: "don't  we'll\n\n  x  'r", 15: "x" * 3000,
        16: "中文 text 漢字 " * 60, 17: "<|endoftext|> </s> \\ <|turn|>", 18: "\x1c \x85 　 end", 19: " ".join(base[:200]) + "\n" + " ".join(base[100:300]),
    }
    rows = [(i, t, "en" if i % 2 else "fr", "src0" if i % 3 else None, len(t or ""), i) for i, t in texts.items()]
    rows += [rows[6], rows[11], rows[19], (None, "no id at all", None, "src1", 12, 0), (100, "The same id.", "en", "src1", 3, 0), (100, "Another text.", "en", "src1", 3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(3)
