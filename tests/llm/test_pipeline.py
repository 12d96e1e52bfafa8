"""The pipeline against a plain Python version of its five stages, on planted rejects, lines, copies and personal data."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from skein.llm import packing
from skein.llm.tokens import load, tokenizer_path

LINE = "This very line stands in several documents"


def prose(k, n=70):
    rng = np.random.default_rng(100 + k)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))


def planted():
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(40 + i, f"{prose(50 + i)}\n {LINE.upper() if i else LINE} \n{prose(60 + i, 9)}") for i in range(4)]
    rows += [(50, "too short"), (51, "a b c " * 60), (52, ""), (53, None)]
    rows += [(60, prose(3)), (61, prose(4).replace(prose(4).split()[30], "changed")), (62, prose(5).upper())]
    rows += [(70 + i, f"Zebulon {prose(70 + i)} zeb@home.org {prose(80 + i)} and Zebulon") for i in range(5)]
    return rows + [(80, f"Zebulon {prose(90)} and others"), (81, f"{prose(91)} call +49 30 1234567 or 10.0.0.1")]


def plain(rows):
    def good(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    docs = {i: t for i, t in rows if good(t)}
    key = lambda line: line.strip().lower()
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    gone = lambda i, line: len(h := holders[key(line)]) >= 3 and i != max(h)
    docs = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}

    def shingles(t):
        w = re.findall(r"\w+", t.lower())
        return Counter(zip(*(w[k:] for k in range(5)), strict=False))

    bags, least = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if bags[a] & bags[b] and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                    least[a] = min(least[a], least[b])
        if all(least[v] == v for v in least.values()):
            break
    docs = {i: t for i, t in docs.items() if least[i] == i}
    marks = [(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", "EMAIL"), (r"10\.0\.0\.1", "IP"), (r"\+49 30 1234567", "PHONE")]  # what is planted
    words = {i: set(re.findall(r"[a-z]{3,40}", re.sub("|".join(p for p, _ in marks), " ", t).lower())) for i, t in docs.items()}
    raw = Counter(w for t in docs.values() for w in set(re.findall(r"[a-z]{3,40}", t.lower())))
    held, total = defaultdict(set), len(docs)
    for i, t in docs.items():
        for p, _ in marks:
            for e in re.findall(p, t):
                held[e.lower()].add(i)
    hidden = set()
    for own in held.values():
        for w, c in Counter(w for i in own for w in words[i]).items():
            pmi = math.log2(c * total / (len(own) * max(raw[w], c)))
            if c >= 3 and pmi >= 0.8 * math.log2(total / len(own)) and 2 * c * math.log(2) * pmi >= 10.83:
                hidden.add(w)
    for i, t in docs.items():
        for p, name in marks:
            t = re.sub(p, f"[{name}]", t)
        docs[i] = re.sub(r"[A-Za-z]{3,40}", lambda m: "[TERM]" if m[0].lower() in hidden else m[0], t)
    return docs


def test_pipeline(spark, tmp_path):
    rows = planted()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    true = plain(rows)
    assert not {50, 51, 52, 53, 60, 61, 62} & set(true) and "[TERM]" in true[70] and "zebulon" not in (true[74] + true[80]).lower() and LINE.upper() not in true[40] + true[41] + true[42] and LINE.upper() in true[43]
    tok = load(tokenizer_path(packing.VOCABULARY))
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in true.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == {(i, 0, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()} and len(out) == len(ids)
    for sequence in {r.sequence_id for r in out}:
        ends = [0, *(r.offset + r.length for r in sorted((r for r in out if r.sequence_id == sequence), key=lambda r: r.offset))]
        assert [r.offset for r in sorted((r for r in out if r.sequence_id == sequence), key=lambda r: r.offset)] == ends[:-1] and ends[-1] <= packing.CAPACITY


def test_stages_with_clashing_columns(spark, tmp_path):
    """Rows share identifiers, and columns have the operators' own names; all stages but the last give them back."""
    rows = [(i, t, f"own{n}", n) for n, (i, t) in enumerate([*planted(), (70, prose(300)), (70, prose(301)), (None, prose(302))])]
    names = ["kept", "n_words", "_words", "_text", "terms", "_spans", "_base", "_row", "_runs", "_digest", "digest", "node", "n_lines", "n_dropped", "mean_word", "_carried", "words", "Text_", "_t", "_at", "base"]
    docs = spark.createDataFrame([(i, t, k, *[n] * len(names)) for i, t, k, n in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.schema.simpleString() == docs.schema.simpleString()
        after.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert all(set(r[3:]) == {int(r.source[3:])} for r in docs.collect())
    left = {int(r.source[3:]): (r.doc_id, r.text) for r in docs.collect()}
    own = len(rows) - 3
    assert [left[own + k] for k in range(3)] == [r[:2] for r in rows[own:]]  # nothing of theirs was mixed or lost
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
