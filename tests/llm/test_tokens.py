import re

import numpy as np
import pyarrow as pa

from spotweave.llm import vectext as vt

TEXTS = ["", None, "A b  c\td\n", "Straße Ünï ABC", "x" * 5000, " \n ", "a\x0bb\x0cc", "same same same"]


def words(text, table, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_as_by_regex_for_any_chunking():
    for limit in (1, 7, 1 << 20):
        for table, pattern in ((vt.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (vt.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            seen = {}
            for i, j, data, at in vt.text_chunks(pa.array(TEXTS), limit):
                w = vt.Words(data, at, table)
                for d in range(j - i):
                    span = range(w.first[d], w.first[d + 1])
                    seen[i + d] = [bytes(vt.LOWER[data[w.start[k] : w.end[k]]]).decode() for k in span], [int(w.hash[k]) for k in span]
            assert [seen[i][0] for i in range(len(TEXTS))] == [words(t, table, pattern) for t in TEXTS]
            flat = [(w, h) for ws, hs in seen.values() for w, h in zip(ws, hs, strict=True)]
            assert len({w for w, _ in flat}) == len({h for _, h in flat}) == len(set(flat))


def test_slices_and_empty_arrays():
    a = pa.array(["aa", "bb cc", "dd"]).slice(1)
    [(i, j, data, at)] = list(vt.text_chunks(a))
    assert (i, j, bytes(data), at.tolist()) == (0, 2, b"bb ccdd", [0, 5, 7])
    assert list(vt.text_chunks(pa.array([], pa.string()))) == []


def test_ngrams_depend_on_order():
    h = np.array([1, 2, 3, 1, 2], dtype=np.uint64)
    g = vt.ngrams(h, 2)
    assert g[0] == g[3] and len(set(g.tolist())) == 3
    assert len(vt.ngrams(h, 6)) == 0
