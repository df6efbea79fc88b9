"""Text expressions and chunking against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, span_hash, strip_line_numbers, word_hashes
from weftline.functions.text import cut_to, extension, is_blank, short_id, strip, tokens, whole_lines
from weftline.operators import chunking


def packed(text, size=1000, overlap=3):
    """Chunks of lines by the plain rule, (start, n)."""
    out, start, held, total = [], 0, [], 0
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if held and total + len(line) + 1 > size:
            out.append((start, len(held)))
            keep = held[-overlap:] if overlap and len(held) > overlap else []
            start += len(held) - len(keep)
            held, total = keep, sum(len(x) + 1 for x in keep)
        held = [*held, line]
        total += len(line) + 1
    return [*out, (start, len(held))] if held else out


def rows(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def test_chunks_of_numbered_lines(spark):
    text = "\n".join(f"Zeile Nr. {i} von vielen" for i in range(1, 91))
    found = chunking.chunks(rows(spark, [text]), "path", "text", 310, 4).orderBy("chunk_index").collect()
    assert len(found) > 1
    assert found[0]["numbered"].startswith("1: Zeile Nr. 1 von vielen\n")
    assert found[1]["start_line"] == found[0]["n_lines"] - 3
    numbers = [int(x.split(":")[0]) for x in found[1]["numbered"].split("\n")]
    assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    assert {n for r in found for n in range(r["start_line"], r["start_line"] + r["n_lines"])} == set(range(1, 91))


def test_chunk_edges(spark):
    found = chunking.chunks(rows(spark, ["", None, "x" * 3000 + "\ny"]), "path", "text").collect()
    by = {}
    for r in found:
        by.setdefault(r["path"], []).append(r)
    assert [(r["clean"], r["numbered"]) for r in by["0"]] == [("", "1: ")]
    assert "1" not in by
    assert [r["n_lines"] for r in sorted(by["2"], key=lambda r: r["chunk_index"])] == [1, 1]
    kept = chunking.indexed(rows(spark, ["  \n\t", "short", "a line that is long enough"]), "path", "text").collect()
    assert [r["id"] for r in kept] == ["2::chunk0"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n\r ж😀", max_size=80), min_size=1, max_size=5), st.integers(5, 40), st.integers(0, 4))
def test_chunks_agree_with_the_plain_rule(spark, texts, size, overlap):
    found = chunking.chunks(rows(spark, texts), "path", "text", size, overlap).collect()
    for i, t in enumerate(texts):
        mine = sorted((r["chunk_index"], r["start_line"] - 1, r["n_lines"]) for r in found if r["path"] == str(i))
        assert [x[1:] for x in mine] == packed(t, size, overlap)


def test_no_files_no_chunks(spark):
    assert chunking.chunks(rows(spark, []), "path", "text").count() == 0


def test_text_expressions(spark):
    df = spark.createDataFrame([("Def x_1(ы): ²",), ("",), (None,), ("\u00a0 \x1c",)], "t string")
    got = df.select(tokens(F.col("t")).alias("k"), is_blank(F.col("t")).alias("b"), strip(F.col("t")).alias("s"), short_id(F.col("t")).alias("i")).collect()
    assert got[0]["k"] == ["def", "x_1", "(", "ы", ")", ":", "²"]
    assert got[1]["k"] == [] and got[2]["k"] is None and got[3]["k"] == []
    assert [r["b"] for r in got] == [False, True, True, True]
    assert got[3]["s"] == "" and len(got[0]["i"]) == 12 and got[2]["i"] is None
    paths = spark.createDataFrame([("a/b.PY",), ("x.tar.gz",), ("Makefile",), (".env",), (None,)], "p string").select(extension(F.col("p"))).collect()
    assert [r[0] for r in paths] == [".py", ".gz", "", "", None]


def test_trimming(spark):
    long = "\n".join(f"{i}: Zeile über {'Maß ' * (i % 5)}🧵" for i in range(1, 90))
    df = spark.createDataFrame([(long,), ("7: ширина",), ("x" * 900,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(whole_lines(F.col("t"), 300)).collect()]
    assert len(got[0]) < 400 and got[0].endswith("... [cut]")
    assert all(line.split(":")[0].isdigit() for line in got[0].split("\n")[:-1])
    assert got[1:] == ["7: ширина", "x" * 300, "", None]
    cut = [r[0] for r in df.select(cut_to(F.col("t"), 10)).collect()]
    assert cut[1] == "7: ширина" and cut[2] == "x" * 10 + "\n... [cut]" and cut[4] is None


def test_blocks_hash_words_wherever_they_stand():
    texts = ["один two", None, "", "two один\ntwo", "x" * 50]
    seen = {}
    for at, block in blocks(texts, limit=8):
        h, t = word_hashes(block)
        for value, i in zip(h.tolist(), at[t].tolist()):
            seen.setdefault(i, []).append(value)
    assert seen[0] == [seen[3][1], seen[3][0]] and seen[3][0] == seen[3][2]
    block = Block(["abcabc", "zabc"])
    p = block.prefix()
    import numpy as np

    assert len(set(span_hash(p, np.array([0, 3, 8]), np.array([3, 6, 11])).tolist())) == 1
    assert strip_line_numbers("1: a\n22: \n3:x\n4: 5: y") == "a\n\n3:x\n5: y"
