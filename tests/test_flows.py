"""Models, retries, files, configuration, whole flows and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verso.operators import history, translators
from verso.plans import flows
from verso.sources import config, files, sinks
from verso.streaming import incremental
from verso.operators.translators import Result, TranslationError


class Faulty:
    """Answers with a scripted list, then like the prefix translator."""

    def __init__(self, *script, bad=()):
        self.script, self.bad, self.prompts = list(script), set(bad), []

    def complete(self, system, messages):
        prompt = messages[-1]["content"]
        self.prompts.append(prompt)
        if self.script:
            x = self.script.pop(0)
            if isinstance(x, Exception):
                raise x
            return Result(x)
        if any(b in prompt for b in self.bad):
            raise TranslationError("RequestFailed", "bad segment")
        return translators.prefix_translator().complete(system, messages)


SEGMENTS = [(k, f"text {k}") for k in range(5)]


def run(model, segments=SEGMENTS, **options):
    return translators.translate_batch(model, segments, "en", "de", sleep=lambda s: None, **options)


def test_ladder():
    expected = {k: f"[TRANSLATED] text {k}" for k in range(5)}
    assert run(Faulty()) == (expected, {}, 1)
    model = Faulty("no markers")
    assert run(model) == (expected, {}, 2) and model.prompts[1].startswith("CRITICAL")
    done, failed, _ = run(Faulty(bad=["text 3"]))
    assert failed == {3: "bad segment"} and done == {k: v for k, v in expected.items() if k != 3}
    swapped = "".join(f"[SEG_{k + 1}]\nx\n" for k in range(5))
    assert run(Faulty(swapped))[2] == 2 and run(Faulty(swapped), strict=False)[2] == 1
    assert run(Faulty(), []) == ({}, {}, 0)


def test_retry():
    waits = []
    limited = TranslationError("RateLimited", "x")
    answers = [limited, TranslationError("Timeout", "x"), Result("ok")]

    def call():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert translators.with_retry(call, 3, 1000, waits.append).translated_text == "ok" and waits == [1.0, 2.0]
    answers[:] = [TranslationError("AuthFailed", "x"), Result("no")]
    with pytest.raises(TranslationError):
        translators.with_retry(call, 3, 1, waits.append)
    with pytest.raises(TranslationError, match="Max retries"):
        translators.with_retry(call, 0, 1, waits.append)


def test_clients():
    seen = []

    def transport(url, headers, body, timeout):
        seen.append((url, json.loads(body), timeout))
        if "messages" in url and "chat" not in url:
            return 200, json.dumps({"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "B"}], "usage": {"input_tokens": 3, "output_tokens": 4}})
        return 200, json.dumps({"choices": [{"message": {"content": "A"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}})

    ask = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    a = translators.create(config.LLMConfig(provider_type="sakura", base_url="http://h/v1/", api_key="k"), transport).complete("", ask)
    b = translators.create(config.LLMConfig(provider_type="anthropic", api_key="k", max_tokens=None), transport).complete("", ask)
    assert (a.translated_text, a.total_tokens, b.translated_text, b.total_tokens, b.think_content) == ("A", 3, "B", 7, "hm")
    assert seen[0][0] == "http://h/v1/chat/completions" and seen[0][1]["messages"][0] == {"role": "system", "content": ""}
    assert "system" not in seen[1][1] and seen[1][1]["messages"][0]["role"] == "user" and seen[1][1]["max_tokens"] == 4096
    for status, kind in ((401, "AuthFailed"), (429, "RateLimited"), (500, "RequestFailed"), (200, "ParseResponseFailed")):
        with pytest.raises(TranslationError) as e:
            translators.create(config.LLMConfig(), lambda *a, s=status: (s, "oops")).complete("", ask)
        assert e.value.kind == kind


def test_settings(tmp_path):
    s = config.Settings(configs=[config.LLMConfig("a", api_key="secret")])
    s.add(config.LLMConfig("b", "anthropic", "m", "k"))
    assert s.current().name == "b"
    s.update(model="n")
    s.save(str(tmp_path / "c.json"))
    assert "secret" not in (tmp_path / "c.json").read_text()
    back = config.Settings.load(str(tmp_path / "c.json"), key="z")
    assert back.current().model == "n" and back.current().api_key == "z" and config.Settings.load(str(tmp_path / "none")) is None
    s.remove(0)
    assert s.active == 0 and s.current().name == "b"
    for wrong in (lambda: s.remove(0), lambda: s.activate(3), lambda: config.parse_provider("x"), lambda: config.LLMConfig().validate()):
        with pytest.raises((ValueError, IndexError)):
            wrong()
    config.save_glossary(str(tmp_path / "g"), "a=b")
    assert config.load_glossary(str(tmp_path / "g")) == "a=b" and config.load_glossary(str(tmp_path / "h")) == ""


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a1.xhtml"/><item id="b" href="1.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/1.xhtml", "<html><body><h1>Second</h1></body></html>")
        z.writestr("OEBPS/a1.xhtml", "<html><body><p>First <b>bold</b></p><p>First bold</p></body></html>")
        z.writestr("OEBPS/i.png", b"\x89PNG\x00\xff")
    return out.getvalue()


def test_epub_flow_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(book())
    (tmp_path / "in" / "bad.epub").write_bytes(b"no zip")
    results = str(tmp_path / "results")
    done = flows.translate_epubs(spark, str(tmp_path / "in"), str(tmp_path / "out"), results, translators.prefix_translator())
    assert sorted((r.seg_idx, r.translation) for r in done.collect()) == [(0, "[TRANSLATED] First bold"), (1, "[TRANSLATED] First bold"), (2, "[TRANSLATED] Second")]
    with zipfile.ZipFile(tmp_path / "out" / "b_translated.epub") as z, zipfile.ZipFile(io.BytesIO(book())) as old:
        assert z.testzip() is None and z.namelist() == old.namelist() and z.read("OEBPS/i.png") == b"\x89PNG\x00\xff"
        assert z.read("OEBPS/1.xhtml").decode() == "<html><body><h1>[TRANSLATED] Second</h1></body></html>"
        assert z.read("OEBPS/a1.xhtml").count(b"[TRANSLATED] First bold") == 2 and b"\x00" not in z.read("OEBPS/a1.xhtml")
    # A second run has nothing to ask.
    flows.translate_epubs(spark, str(tmp_path / "in"), str(tmp_path / "out"), results, Faulty(bad=["SEG"]))
    entries = files.archive_entries(files.read_binary(spark, str(tmp_path / "in"), "b.epub"))
    assert [r.entry_name for r in entries.orderBy("entry_idx").collect()][0] == "mimetype"
    assert files.epub_sections(files.read_binary(spark, str(tmp_path / "in"), "bad.epub")).first().error


def test_equal_names_and_damaged_books(spark, tmp_path):
    for folder in ("x", "y/z"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "b.epub").write_bytes(book())
    (tmp_path / "in" / "bad.epub").write_bytes(b"no zip")
    results = str(tmp_path / "results")
    flows.translate_epubs(spark, str(tmp_path / "in"), str(tmp_path / "out"), results, translators.prefix_translator(), pause=0)
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.epub")) == ["x/b_translated.epub", "y/z/b_translated.epub"]
    damaged = spark.read.parquet(flows.damaged_path(results)).collect()
    assert len(damaged) == 1 and damaged[0].path.endswith("bad.epub") and damaged[0].error
    with pytest.raises(ValueError, match="bad.epub"):
        flows.translate_epubs(spark, str(tmp_path / "in"), str(tmp_path / "out"), results, translators.prefix_translator(), strict=True)
    with pytest.raises(ValueError, match="path of its own"):
        sinks.write_files(spark.createDataFrame([("a", "1"), ("a", "2")], "n string, c string"), str(tmp_path / "o"), F.col("n"), F.col("c"))
    with pytest.raises(ValueError, match="path of its own"):
        sinks.write_files(spark.createDataFrame([("../a", "1")], "n string, c string"), str(tmp_path / "o"), F.col("n"), F.col("c"))
    sinks.write_file_results(spark.createDataFrame([("n.txt", "1"), ("", "2")], "name string, content string"), str(tmp_path / "o"), 7)
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["translated_7.txt", "translated_n.txt"]


def test_cache_answers_and_results_come_in_parts(spark, tmp_path):
    segments = spark.createDataFrame([(d, k, f"text {(d * 7 + k) % 40}") for d in range(10) for k in range(12)], "doc_id bigint, seg_idx int, text string")
    cache, first, second = (str(tmp_path / x) for x in ("cache", "first", "second"))
    waits = []
    done = flows.translate(segments, translators.prefix_translator(), "en", "de", first, cache=cache, model="m", pause=0, at_once=2)
    assert done.count() == 120 and all(r.translation.startswith("[TRANSLATED] text") for r in done.collect())
    assert spark.read.parquet(cache).count() == 40
    # Another flow over the same texts sends nothing; another model's does.
    again = flows.translate(segments, Faulty(bad=["SEG"]), "en", "de", second, cache=cache, model="m", pause=0, retries=1)
    assert again.filter("translation is not null").count() == 120
    other = flows.translate(segments.limit(3), Faulty(bad=["SEG"]), "en", "de", str(tmp_path / "third"), cache=cache, model="other", pause=0, retries=1)
    assert other.filter("translation is null").count() == 3
    assert [(r.doc_id, r.n_failed, [e.error for e in r.errors]) for r in flows.failures(other).collect()] == [(0, 3, ["bad segment"] * 3)]
    translators.translate_batch(translators.prefix_translator(), SEGMENTS, "en", "de", sleep=waits.append, pause=0.1)
    assert waits == [0.1]


def test_a_stopped_run_keeps_what_it_had(spark, tmp_path):
    """Results are appended part by part: what was appended before a failure is not sent again."""
    segments = spark.createDataFrame([(d, 0, f"text {d}") for d in range(12)], "doc_id bigint, seg_idx int, text string")
    results, calls = str(tmp_path / "r"), []
    real = translators.run_batches

    def stops(batches, *a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        return real(batches, *a, **k)

    translators.run_batches = stops
    try:
        with pytest.raises(RuntimeError):
            flows.translate(segments, translators.prefix_translator(), "en", "de", results, pause=0, at_once=3)
    finally:
        translators.run_batches = real
    kept = flows.read_results(spark, results).count()
    assert 0 < kept < 12
    done = flows.translate(segments, translators.prefix_translator(), "en", "de", results, pause=0)
    assert done.count() == 12 and spark.read.parquet(results + "_plan").count() == 12 - kept


def test_positioned_flow(spark, tmp_path):
    rows = [(1, 0, k, t, 72.0 + 18 * (k == 2), 780.0 - 40 * k, 17.0 if k == 3 else 11.0, k == 1, False) for k, t in enumerate(["Head.", "code()", "Body text.", "evil."])]
    positioned = spark.createDataFrame(rows, "doc_id bigint, page int, span_idx int, text string, x float, y float, font_size float, is_monospace boolean, is_italic boolean")
    images = spark.createDataFrame([(1, 0, 0, 500.0, 100.0, 50.0, None)], "doc_id bigint, page int, img_idx int, y float, width float, height float, data binary")
    out, results = str(tmp_path / "laid"), str(tmp_path / "r")
    done = flows.translate_positioned(positioned, images, out, results, Faulty(bad=["evil"]), pause=0, retries=1)
    assert {r.error for r in done.collect()} == {None, "bad segment"}
    lines = spark.read.parquet(out).orderBy("page_no", "line_no").collect()
    assert [(r.font, r.text) for r in lines] == [("body", "[TRANSLATED] Head."), ("bar", ""), ("mono", "code()"), ("body", "[TRANSLATED] Body text."), ("bold", "evil."), ("image", "")]
    assert [r.x for r in lines if r.text.endswith("Body text.")] == [90.0] and [r.x for r in lines if r.text == "code()"] == [102.0]


def test_history_files_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"o{k}", f"t{k}") for k in range(20)], "seq bigint, original string, translated string").repartition(4)
    history.write_export(rows, "seq", str(tmp_path / "e"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))
    assert text == "".join(f"[Original]\no{k}\n[Translated]\nt{k}\n---" for k in range(20))
    path = history.write_history(rows, str(tmp_path), 5)
    assert path.endswith("history_5.json") and spark.read.json(path).count() == 20
    assert [r.seq for r in history.previews(rows, "seq", 3).collect()] == [0, 1, 2]


def test_failures_are_resumed_and_gaps_named(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, "good"), (1, 1, "evil"), (2, 0, "good")], "doc_id bigint, seg_idx int, text string")
    results = str(tmp_path / "r")
    first = flows.translate(segments, Faulty(bad=["evil"]), "en", "de", results, sleep=None, retries=1)
    assert {(r.doc_id, r.seg_idx): r.error for r in first.collect()} == {(1, 0): None, (1, 1): "bad segment", (2, 0): None}
    with pytest.raises(ValueError, match="document 1: segment 1"):
        flows.require_complete(segments, first)
    second = flows.translate(segments, translators.identity_translator(), "en", "de", results)
    flows.require_complete(segments, second)
    assert {(r.doc_id, r.seg_idx): r.translation for r in second.collect()} == {(1, 0): "[TRANSLATED] good", (1, 1): "evil", (2, 0): "[TRANSLATED] good"}


def test_markdown_flow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Title\n\nSome **bold** `x`\n")
    flows.translate_markdown(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "r"), translators.identity_translator())
    assert (tmp_path / "out" / "a_translated.md").read_text() == "# Title\n\nSome**bold**`x`\n"


def test_entry_matching():
    assert sinks.section_for_entry("OEBPS/1.xhtml", ["a1.xhtml", "1.xhtml"]) == 1 and sinks.section_for_entry("OEBPS/a1.xhtml", ["1.xhtml"]) is None
    assert sinks.section_for_entry("x", ["y", "x"]) == 1


def test_progress(spark):
    rows = spark.createDataFrame([(1, 0, 3, 1, 1), (1, 1, 1, 2, 0)], "doc_id bigint, batch_idx int, n_segments int, attempts int, successes int")
    got = sinks.progress(rows).orderBy("batch_idx").collect()
    assert [(r.current, r.total, r.attempts, r.successes, r.percent) for r in got] == [(3, 4, 1, 1, 75.0), (4, 4, 3, 1, 100.0)]


def test_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], incremental.PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.translate_pages(spark, str(tmp_path / "in"), str(tmp_path / "r"), str(tmp_path / "c"), translators.prefix_translator()).awaitTermination()
        pages.withColumn("page_id", F.col("page_id") + 1).write.mode("append").parquet(str(tmp_path / "in"))
    got = flows.read_results(spark, str(tmp_path / "r")).collect()
    assert sorted((r.doc_id, r.translation) for r in got) == [(1, "[TRANSLATED] a"), (2, "[TRANSLATED] a")]
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:20:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in incremental.event_counts(events).collect()] == [(2, 3.0)]


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
