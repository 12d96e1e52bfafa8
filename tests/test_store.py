import json

import pytest

from skein.operators import answers, health
from skein.operators.json_records import Profile, file_records
from skein.operators.retrieval import retrieve
from skein.operators.search import search
from skein.plans.store import Store
from skein.sources import files as fs


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.txt": "alpha beta gamma. 中文索引", "sub/b.md": "beta delta", "skip/c.txt": "hidden", "build/d.txt": "never", "e.json": '[{"t": "one"}, {"t": "two"}]'}.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return tmp_path


def test_discover(tree):
    found = [p.rsplit("/", 1)[1] for p in fs.discover([str(tree / "in"), str(tree / "in/sub")], exclude_dirs=["skip"])]
    assert found == ["a.txt", "b.md"]
    assert len(list(fs.discover([str(tree / "in")], max_files=1))) == 1
    with pytest.raises(ValueError):
        list(fs.discover([], max_files=-1))


def test_decode():
    assert fs.decode("中文".encode("gb18030")) == "中文"
    assert fs.decode("﻿x".encode()) == "x"
    assert "�" in fs.decode(b"abc\xff\xff")


def test_index_search_remove(spark, tree):
    store = Store(spark, f"file://{tree}/store")
    stats = store.index([str(tree / "in")], exclude_dirs=["skip"])
    assert (stats["indexed"], stats["skipped"], stats["failed"]) == (2, 0, 0)
    assert store.index([str(tree / "in")], exclude_dirs=["skip"])["skipped"] == 2
    (tree / "in/a.txt").write_text("omega beta", encoding="utf-8")
    assert store.index([str(tree / "in")], exclude_dirs=["skip"])["indexed"] == 1
    hits = search(store.read(), {1: "beta", 2: "alpha", 3: "omega"}).collect()
    assert sorted((r["query_id"], r["filename"]) for r in hits) == [(1, "a.txt"), (1, "b.md"), (3, "a.txt")]
    assert health.issues(store.read()).isEmpty()
    path = str((tree / "in/a.txt").resolve())
    assert store.remove(path) and not store.remove(path)
    (tree / "in/sub/b.md").unlink()
    assert store.prune(spark.createDataFrame([], "path string")) == 1
    assert store.read().documents.isEmpty()


def test_json_files(spark, tree):
    store = Store(spark, f"file://{tree}/store")
    profile = Profile.from_config({"fields": [{"name": "t", "path": "t"}], "filter": {"path": "t", "not_equals": "one"}})
    assert store.index([str(tree / "in")], profile=profile, exclude_dirs=["skip"])["indexed"] == 3
    assert [r["filename"] for r in search(store.read(), {1: "two"}).collect()] == ["e.json"]
    assert list(file_records('{"a": [1, 2]} {"a": [3]}', "$.a[*]")) == [1, 2, 3]
    with pytest.raises(ValueError):
        list(file_records('[{"a": 1},]'))


def test_ask(spark, tree):
    store = Store(spark, f"file://{tree}/store")
    store.index([str(tree / "in")])
    index, lines = store.read(), []
    reply = lambda text: lambda messages, temperature: {"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 3}}
    assert answers.ask(index, "beta delta", reply("It is delta [1] KEY"), audit=lines.append, key="KEY")["refused"] is False
    assert "KEY" not in lines[0] and json.loads(lines[0].removeprefix(answers.MARKER))["event"] == "rag_answer"
    with pytest.raises(answers.CitationError):
        answers.ask(index, "beta delta", reply("no source"), audit=lines.append)
    assert json.loads(lines[1].removeprefix(answers.MARKER))["event"] == "rag_error"
    assert answers.ask(index, "zzzz")["refused"] is True
    row = retrieve(index, {0: "beta delta"}, budget=20).first()
    assert row["truncated"]


def test_stream(spark, tree):
    from skein.streaming.indexer import watch

    store = Store(spark, f"file://{tree}/store")
    watch(spark, str(tree / "in"), store, str(tree / "ckpt")).awaitTermination()
    assert {r["filename"] for r in store.read().documents.collect()} >= {"a.txt", "b.md"}


def test_record_mode(spark, tmp_path):
    """Records are chunked each on its own and numbered on; a long one comes raw; a broken file keeps what it had."""
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    folder.mkdir()
    (folder / "a.json").write_text('[{"t": "one"}, {"t": "two"}, {"x": 1}, {"t": "three"}]', encoding="utf-8")
    (folder / "b.txt").write_text("plain", encoding="utf-8")
    listed = lambda: sorted((r["filename"], r["chunk_index"], r["content"]) for r in store.read().chunks.join(store.read().documents, "doc_id").collect())
    config = {"fields": ["t"]}
    assert store.index([str(folder)], profile=Profile.from_config(config))["indexed"] == 2
    assert listed() == [("a.json", 0, "one"), ("a.json", 1, "two"), ("a.json", 2, "three"), ("b.txt", 0, "plain")]
    assert store.index([str(folder)], profile=Profile.from_config(config | {"index_mode": "file"}), force=True)["indexed"] == 2
    assert listed() == [("a.json", 0, "one\ntwo\nthree"), ("b.txt", 0, "plain")]
    (folder / "a.json").write_text('[{"t": "one"}, {"t":  "%s"}]' % ("é" * 60), encoding="utf-8")
    assert store.index([str(folder)], profile=Profile.from_config(config), probe=100)["indexed"] == 2
    assert listed()[:2] == [("a.json", 0, "one"), ("a.json", 1, '{"t": "%s"}' % ("é" * 60))]
    (folder / "a.json").write_text('[{"t": "new"}, {"t": ', encoding="utf-8")
    assert store.index([str(folder)], profile=Profile.from_config(config))["failed"] == 1 and listed()[0][2] == "one"


def test_readers_and_writers(spark, tmp_path):
    """A reader sees whole versions only; of two writers from one version the second fails."""
    store = Store(spark, f"file://{tmp_path}/store")
    raw = lambda text: spark.createDataFrame([("/a.txt", "a.txt", "txt", text, 1, 1, "", text)], "path string, filename string, file_type string, sha256 string, size long, modified_ns long, parser_fingerprint string, text string")
    store.replace(raw("first"))
    seen, commit = [], store.commit

    def while_writing(*args):
        seen.append((store.version(), [r["content"] for r in store.read().chunks.collect()]))
        Store(spark, store.root).replace(raw("between"))
        return commit(*args)

    store.commit = while_writing
    with pytest.raises(RuntimeError):
        store.replace(raw("second"))
    assert seen == [(1, ["first"])] and [r["content"] for r in Store(spark, store.root).read().chunks.collect()] == ["between"]
    (tmp_path / "store" / "v=9").mkdir()  # a writer that failed
    assert store.version() == 2


def test_directory_filter(spark, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    for name in ("one/a.txt", "one/b.txt", "one_more/c.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("same words", encoding="utf-8")
    store.index([str(folder)])
    names = lambda path: sorted(r["filename"] for r in search(store.read(), {0: "same"}, path=path).collect())
    assert names(str(folder / "one")) == names(f"{folder}/one/") == names(f"{folder}/two/../one") == ["a.txt", "b.txt"]
    assert names(str(folder / "one/a.txt")) == ["a.txt"] and names(str(folder / "none")) == []


def test_evaluation_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from skein import cli
    from skein.operators import evaluation
    from skein.operators.client import HttpClient, settings

    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("The ratio is 3:1 and blue.", encoding="utf-8")
    (tmp_path / "e.json").write_text('[{"a": {"b c": [1, "x"]}}, {"a": null}, {"a": 2}]', encoding="utf-8")
    (tmp_path / "p.json").write_text('{"fields": [{"name": "A", "path": "$.a"}]}', encoding="utf-8")
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "kind": "fact", "question": "ratio blue", "expected_source": "a.md", "facts": [{"label": "r", "answer_any": ["3:1"], "evidence_any": ["ratio is 3:1"]}]}, {"id": "c2", "kind": "refusal", "question": "zzzz", "expected_sources": [], "expected_refused": True}]), encoding="utf-8")
    client = lambda messages, temperature: {"choices": [{"message": {"content": "It is 3:1 [1]"}}], "usage": {"total_tokens": 7}}

    def call(*args):
        code = cli.run(cli.parser().parse_args([*args, "--db", "store"]), spark, client)
        return code, capsys.readouterr().out

    assert call("init-db")[0] == 0 and call("index", "in")[0] == 0
    assert "[[ratio]]" in call("search", "ratio", "--no-color", "--path", "in")[1] and call("search", "ratio", "--path", "elsewhere")[1] == ""
    assert call("ask", "ratio blue", "--top-k", "2", "--log-file", "audit/x.log")[1].startswith("It is 3:1 [1]\n[1] a.md")
    assert fs.audit_records(spark, str(tmp_path / "audit/x.log"), answers.MARKER, evaluation.RECORD).select("question").collect() == [("ratio blue",)]
    assert call("json-preview", "e.json", "--json-config", "p.json", "--limit", "2")[1] == 'A: {"b c": [1, "x"]}\nA: 2\n'
    out = call("json-structure", "e.json", "--max-records", "2")[1]
    assert '"complete": false' in out and '$.a["b c"][*]\tinteger\t1' in out and "$.a\tnull\t1" in out and "$.a\tinteger" not in out
    assert '"complete": true' in call("json-structure", "e.json")[1]
    with pytest.raises(ValueError):
        call("json-preview", "e.json", "--json-config", "p.json", "--json-record-probe-size", "9")
    code, _ = call("eval", "cases.json")
    first, second = map(json.loads, (tmp_path / "cleaned.jsonl").read_text(encoding="utf-8").splitlines())
    assert first["passed"] and first["cited_evidence"][0]["excerpt"].endswith("The ratio is 3:1 and blue.") and second["refusal_correct"] and not second["citations_valid"]
    assert "cases passed: 1/2" in (tmp_path / "report.md").read_text() and code == 1
    assert [r.matched for r in evaluation.without_context(evaluation.cases(spark, "cases.json"), client).orderBy("case_id").collect()] == [["r"], []]
    (tmp_path / "in/a.md").unlink()
    assert call("prune")[1] == "1\n" and call("check-db") == (0, "healthy\n") and call("list")[1] == "" and call("remove", "in/a.md")[0] == 1
    (tmp_path / ".env").write_text("LLM_API_KEY='k'\nexport LLM_MODEL=m\n")
    known = settings(str(tmp_path), {"LLM_MODEL": "own"})
    assert known == {"LLM_API_KEY": "k", "LLM_MODEL": "own"}
    with pytest.raises(answers.ModelError, match="LLM_BASE_URL"):
        HttpClient.from_settings(known)
    with pytest.raises(answers.ModelError, match="could not be asked") as e:
        HttpClient("k3y", "http://127.0.0.1:9", "m", 2)([], 0)
    assert "127.0.0.1:9/" not in str(e.value)


def test_excerpt(spark):
    from pyspark.sql import functions as F

    from skein.functions import text as tx

    words = " ".join(f"w{i:03d}" for i in range(200))
    facts = [[["none", "w050"]], [["w010"], ["w150"]], [["w020"], ["w045"]], [["absent"]], None, [["w 0 60"]], [["w199"], ["w000"]]]
    rows = spark.createDataFrame([(k, f" {words}\n ", f) for k, f in enumerate(facts)] + [(9, None, [["x"]])], "k int, t string, f array<array<string>>")
    at = lambda *spans: " ... ".join(words[max(0, 5 * a - 70) : min(len(words), 5 * b + 150)].strip() for a, b in spans)
    true = [at((50, 50)), at((10, 10), (150, 150)), at((20, 45)), words[:400], words[:400], at((60, 60)), at((0, 0), (199, 199)), ""]
    assert [r[0] for r in rows.select("k", tx.relevant_excerpt(F.col("t"), F.col("f")).alias("e")).orderBy("k").select("e").collect()] == true


def test_sources(spark, tmp_path):
    """Catalogue, sizes, and PDF and PPTX where their packages are missing."""
    (tmp_path / "c.json").write_text('{"datasets": [{"name": "a", "size_gb": 1.5}, {"name": "b", "size_gb": 2}]}')
    assert sorted(map(tuple, fs.catalogue(spark, str(tmp_path / "c.json")).select("name", "size_gb").collect())) == [("a", 1.5), ("b", 2.0)]
    for name in ("x.pdf", "y.pptx"):
        (tmp_path / name).write_bytes(b"nothing of the kind")
    (tmp_path / "z.txt").write_bytes("中文".encode("gb18030"))
    stats = Store(spark, f"file://{tmp_path}/store").index([str(tmp_path)], max_json=10)
    assert (stats["failed"], stats["indexed"]) == (2, 1)


def test_commits_copy_nothing(spark, tmp_path):
    """A commit writes its own chunks alone; rows of replaced documents do not count; many parts become one."""
    from skein.plans import store as plans

    store = Store(spark, f"file://{tmp_path}/store")
    raw = lambda *names, text="some words": spark.createDataFrame([(f"/{n}", n, "txt", n, 1, 1, "", f"{text} of {n}") for n in names], "path string, filename string, file_type string, sha256 string, size long, modified_ns long, parser_fingerprint string, text string")
    store.replace(raw(*"abcdef"))
    kept = sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "store/part-1").iterdir())
    for k in range(plans.PARTS - 1):
        store.replace(raw("b", text=f"other{k}"))
    assert store.prune(raw(*"abcd").select("path")) == 2
    assert sum(p.name.startswith("part-") for p in (tmp_path / "store").iterdir()) == plans.PARTS + 1  # the last commit made one of all; earlier versions still read theirs
    found = store.read()
    assert sorted(r["content"] for r in found.chunks.collect()) == sorted([f"some words of {n}" for n in "acd"] + [f"other{plans.PARTS - 2} of b"])
    assert sorted(r["path"] for r in found.documents.collect()) == ["/a", "/b", "/c", "/d"] and health.issues(found).isEmpty()
    assert {r["field"]: (r["n_chunks"], r["avg_length"]) for r in found.stats.collect()} == {"token": (4, 3.75), "raw": (4, 3.75)}
    assert store._made_of(store.version())[1] == 0 and store._made_of(store.version() - 1)[0] == list(range(1, plans.PARTS + 1))
    assert sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "store/part-1").iterdir()) == kept
