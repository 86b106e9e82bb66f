import re

import numpy as np
import pyarrow as pa

from atrium.llm import rules, words

TEXTS = ["one two\tthree", None, "", " \n", "é ünï\r\nx", "a", "a b c d e a b c d e", "x" * 5000 + " y", "tail "]


def test_words_follow_the_pattern():
    w = words.words(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        got = words.strings(w, np.arange(w.first[i], w.first[i + 1]))
        assert got == re.findall(words.WORD, t or "")


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = words.words(pa.array(["b a", "a", "c a b"]))
    h = words.word_hashes(w).tolist()
    assert h[0] == h[5] and h[1] == h[2] == h[4] and len(set(h)) == 3


def test_shingles_of_short_and_repeated_texts():
    w = words.words(pa.array(TEXTS))
    sizes = [len(s) for s in words.shingles(w, words.word_hashes(w))]
    assert sizes == [1, 0, 0, 0, 1, 1, 6 - 1, 1, 1]


def test_slices_keep_every_row_and_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["i", "text"])
    cut = list(words.slices(iter([batch]), limit=20))
    assert [i for b in cut for i in b.column("i").to_pylist()] == list(range(len(TEXTS)))
    assert len(cut) > 2


def test_rule_counts_against_a_plain_count():
    texts = TEXTS + ["a b\na b\n a b\n", "# x *\n# x *", "u v w u v w", "AB CD\nef."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = pa.Table.from_batches(list(rules.features(iter([batch])))).to_pylist()
    for row, t in zip(got, texts):
        t = t or ""
        ws, seen, again = re.findall(words.WORD, t), set(), 0
        for line in t.split("\n"):
            if re.search(words.WORD, line):
                again += line in seen
                seen.add(line)
        tri = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        covered = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(ws), sum(map(len, ws)), again, len(covered)), t
        assert row["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
