"""Counters, catalogues, evaluation, dialogues and files on small made-up rows."""

import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import catalog as C
from parlance.operators import dialogue as D
from parlance.operators import evaluation as E
from parlance.operators import records as R
from parlance.sources import files as S

T0 = datetime(2024, 1, 1, 10)


def _rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_counters(spark):
    u = spark.createDataFrame([("t", T0, True, "a", True, ["r1", "r2"]), ("t", T0, True, " ", True, []), ("t", T0, False, "b", True, []), ("t", T0, True, "c", False, None)], "tenant_id string, ts timestamp, is_final boolean, clean_text string, pii_masked boolean, matched_rules array<string>")
    r = spark.createDataFrame([("t", T0, True, 0.5, 100), ("t", T0, True, 0.25, 50), ("t", T0, False, 9.0, 9)], "tenant_id string, ts timestamp, is_final boolean, confidence double, duration_ms int")
    b = spark.createDataFrame([("t", T0, True), ("t", T0, False)], "tenant_id string, ts timestamp, handed_off boolean")
    d = spark.createDataFrame([("t", T0, "ready", 5, 40, False), ("t", T0, "ready", 5, 0, False), ("t", T0, "failed", 7, 30, True)], "tenant_id string, ts timestamp, status string, waited_ms int, latency_ms int, gave_up boolean")
    c = spark.createDataFrame([("t", T0, "meeting"), ("t", T0, "aicc"), ("t", T0, "aicc")], "tenant_id string, ts timestamp, profile string")
    day = R.with_ratios(R.merged_counters(R.utterance_counters(u), R.recognition_counters(r), R.bot_counters(b), R.summary_counters(d), R.session_counters(c))).collect()
    assert len(day) == 1 and day[0]["day"] == "2024-01-01"
    want = dict(utterances=2, pii_masked=1, rule_hits=2, confidence_sum=0.75, confidence_n=2, audio_ms=150, bot_turns=2, handoffs=1, summaries_ready=2, summaries_failed=1, summary_latency_sum=40, summary_latency_n=1, summary_waited_sum=17, summary_gave_up=1, sessions=3, sessions_meeting=1, sessions_aicc=2)
    assert {k: day[0][k] for k in want} == want
    assert (day[0]["mean_confidence"], day[0]["mean_summary_latency_ms"], day[0]["handoff_rate"], day[0]["summary_success"]) == (0.375, 40.0, 0.5, pytest.approx(2 / 3))


def test_joins_of_events(spark):
    settings = spark.createDataFrame([("a", 1, True, "old"), ("a", 2, True, "new"), ("a", 3, False, "draft"), ("b", 1, True, None)], "tenant_id string, version int, published boolean, value string")
    events = spark.createDataFrame([("a",), ("b",), ("c",)], "tenant_id string")
    assert _rows(R.with_settings(events, settings, F.lit("default")), "tenant_id", "settings") == [("a", "new"), ("b", "default"), ("c", "default")]
    said = spark.createDataFrame([("s", 0, "x"), ("s", 5, "y")], "session_id string, start_ms int, speaker_id string")
    labels = spark.createDataFrame([("s", 5, "speaker_1", 1), ("s", 5, "speaker_2", 2), ("s", 9, "speaker_3", 3)], "session_id string, start_ms int, speaker_id string, ts int")
    assert _rows(R.labelled(said, labels), "start_ms", "speaker_id") == [(0, "x"), (5, "speaker_2")]
    turns = spark.createDataFrame([("s", 1, 1, "customer", "help", "", False), ("s", 2, 2, "bot", "wait", "n1", False), ("s", 3, 3, "bot", "bye", "n2", True), ("q", 1, 1, "bot", "bye", "n2", True)], "session_id string, seq int, ts int, role string, text string, node_id string, handed_off boolean")
    assert _rows(R.handoff_utterances(turns), "session_id", "node_id", "text") == [("s", "n2", "help")]
    calls = spark.createDataFrame([("s", None), ("q", "ready")], "session_id string, summary_status string")
    done = spark.createDataFrame([("s", "failed", 1), ("s", "ready", 2), ("z", "ready", 1)], "session_id string, status string, ts int")
    assert _rows(R.with_summary_status(calls, done), "session_id", "summary_status") == [("q", "ready"), ("s", "ready")]
    history = spark.createDataFrame([("a", k, f"v{k}", T0) for k in range(1, 4)], "id string, version int, value string, published_at timestamp")
    fresh = spark.createDataFrame([("a", "new", T0), ("b", "first", T0)], "id string, value string, published_at timestamp")
    assert _rows(R.published(fresh, history, 2), "id", "version", "value") == [("a", 3, "v3"), ("a", 4, "new"), ("b", 1, "first")]
    frames = spark.createDataFrame([("s", 2, "AAA="), ("s", 1, "AAAA"), ("s", 0, "AAAAAA=="), ("s", 3, "?")], "session_id string, ts int, audio string")
    assert _rows(R.audio_chunks(frames), "seq", "ts") == [(1, 0), (2, 2)]
    one = spark.range(1)
    days = one.select(R.recent_days(F.lit(date(2024, 3, 1)), 3).alias("d"), R.licence_state(F.lit(date(2024, 3, 1)), F.lit(date(2024, 1, 31))).alias("g"), R.licence_state(F.lit(date(2024, 3, 1)), F.lit(date(2024, 1, 30))).alias("e")).first()
    assert days["d"] == ["2024-02-28", "2024-02-29", "2024-03-01"] and tuple(days["g"]) == (-30, "grace") and tuple(days["e"]) == (-31, "expired")


def test_catalogue(spark):
    schema = "id string, depends_on array<string>, recommends array<string>, consumes array<string>, produces array<string>, included boolean, capacity_unit string"
    blocks = spark.createDataFrame([("A", ["B"], ["R", "none"], ["t1", "t2"], [], True, "none"), ("B", ["A"], [], [], ["t0"], True, "none"), ("P", [], [], [], ["t1", "t2"], False, "none"), ("Q", ["X"], [], [], ["t2"], True, "x"), ("R", [], [], ["t9"], [], True, "x"), ("L", [], [], [], [], True, "x")], schema)
    assert _rows(C.bundle(blocks, spark.createDataFrame([("A",), ("Z",)], "id string"), ("L",)), "id", "reason") == [("A", "requested"), ("B", "dependency"), ("L", "requested"), ("P", "dependency"), ("R", "recommended"), ("Z", "unknown")]
    assert _rows(C.catalogue_problems(blocks), "id", "problem", "name") == [("A", "cycle", "A"), ("B", "cycle", "A"), ("P", "unbillable", ""), ("Q", "unknown dependency", "X"), ("R", "no producer", "t9")]
    good = {"p": "a" * 64}
    releases = [("x", 1, "0.1.0", "2024-01-01", "a" * 40, good), ("x", 2, "0.2.0-rc.1", "2024-01-02", "a" * 40, good), ("x", 3, "0.2.0", "2023-01-02", "a" * 40, good), ("x", 4, "v1", "2024-01-01", "", {}), ("x", 5, "0.2.0", "24-1-1", "b", {"p": "z"}), ("x", 6, "0.10.0", "2024-01-09", "a" * 40, {})]
    rows = spark.createDataFrame(releases, "product string, line int, version string, released_at string, commit string, packages map<string,string>")
    assert _rows(C.release_faults(rows), "line", "problem") == [(3, "date goes back"), (4, "version"), (5, "commit"), (5, "date"), (5, "digest"), (5, "repeated"), (5, "version goes back"), (6, "date goes back"), (6, "no packages")]
    plan = spark.range(1).select(C.capacity(F.lit(1000), F.lit("stt-small-gpu"), with_tts=True).alias("c")).first()["c"]
    assert tuple(plan) == (1500, 24, 12, 8, False)
    limit = spark.createDataFrame([("b", 10, True), ("a", 10, True), ("c", 1, False), ("d", None, True)], "id string, concurrent_channels int, enabled boolean")
    assert C.channel_limit(limit).first() == (10, "a") and C.status(spark.createDataFrame([(True,), (False,)], "ready boolean")).first() == (1, 2, False)
    assert _rows(C.effort(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 0.5)], "tier string, effort double")), "tier", "blocks", "effort") == [("x", 2, 3.0), ("y", 1, 0.5), (None, 3, 3.5)]
    found = C.secrets(spark.createDataFrame([("a/x", bytearray(b"-----BEGIN RSA PRIVATE KEY-----")), ("b/.env", bytearray(b"")), ("c", bytearray(b"PRIVATE KEY"))], "path string, content binary"))
    assert _rows(found, "path", "problem") == [("a/x", "private key"), ("b/.env", "secret")]


def test_evaluation(spark):
    cases = spark.createDataFrame([("s", "1", "a", "a"), ("s", "2", "a", "b"), ("s", "3", "a", None), ("s", "4", None, None), ("s", "5", None, "b")], "suite string, case_id string, expect string, chosen string")
    checks = E.intent_checks(cases).withColumn("known_limitation", F.col("case_id") == "3").withColumn("latency_ms", F.col("case_id").cast("double"))
    got = E.check_metrics(checks, ["suite"]).first()
    assert tuple(got) == ("s", 5, 2, 0.4, 1, 2, 3.0, 5.0)
    ranks = spark.createDataFrame([("x", float(k)) for k in range(1, 21)] + [("y", 7.0)], "g string, v double")
    assert _rows(E.nearest_rank(ranks, ["g"], "v", 0.95), "g", "percentile") == [("x", 19.0), ("y", 7.0)]
    spans = E.span_checks(spark.createDataFrame([("1", "card"), ("2", "email")], "case_id string, kind string"), spark.createDataFrame([("1", "card"), ("2", "card")], "case_id string, kind string"))
    assert _rows(spans, "case_id", "missed", "extra", "passed") == [("1", [], [], True), ("2", ["card"], ["email"], False)]
    pairs = spark.createDataFrame([("1", "안녕, 세상!", "안녕 세계"), ("2", "a b c", ""), ("3", "\u1100\u1161", "가")], "case_id string, reference string, heard string")
    scores = E.transcript_scores(pairs)
    assert _rows(scores, "case_id", "word_errors", "words", "character_errors", "characters", "empty") == [("1", 1, 2, 1, 4, False), ("2", 3, 3, 3, 3, True), ("3", 0, 1, 0, 1, False)]
    assert tuple(E.transcript_metrics(scores).first()) == (3, 0.667, 0.5, 1)
    gaps = E.coverage_gaps(spark.createDataFrame([("1", "a"), ("2", "z")], "case_id string, doc_id string"), spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert _rows(gaps, "case_id", "doc_id", "gap") == [("2", "z", "not in the corpus"), (None, "b", "never expected")]


NODES = [
    dict(node_id="start", kind="say", prompt="hi", next_node="ask"),
    dict(node_id="ask", kind="ask", prompt="what?", reprompt="again?", slot="wish", max_retries=1, next_node="fork", intents=[dict(name="fee", patterns=["fee|cost"], next_node=""), dict(name="agent", patterns=["person"], next_node="person")]),
    dict(node_id="fork", kind="branch", next_node="end", intents=[dict(name="x", patterns=["cost"], next_node="person")]),
    dict(node_id="person", kind="handoff", prompt="one moment"),
    dict(node_id="end", kind="end", prompt="bye"),
]


def _nodes(spark, extra=()):
    keys = [x.split()[0] for x in D.NODE.split(", ")]
    full = [{"scenario": "s", "prompt": "", "reprompt": "", "next_node": "", "slot": "", "max_retries": 0, "intents": [], **n} for n in (*NODES, *extra)]
    return spark.createDataFrame([tuple(n[k] if k != "intents" else [(i["name"], i["patterns"], i["next_node"]) for i in n[k]] for k in keys) for n in full], D.NODE), full


def test_dialogues(spark):
    frame, nodes = _nodes(spark)
    rows = [("a", 0, "the FEE please", None), ("b", 0, "mumble", None), ("b", 1, None, None), ("b", 2, "too late", None), ("c", 0, "what cost", None), ("d", 0, "hm", "agent"), ("e", 0, "hm", "unknown"), ("e", 1, "fee", None)]
    got = {(r["session_id"], r["seq"]): r for r in D.played(spark.createDataFrame(rows, "session_id string, seq int, text string, intent string"), nodes, "start", "person").collect()}
    ids = {k: [s["node_id"] for s in r["said"]] for k, r in got.items()}
    assert ids == {("a", -1): ["start", "ask"], ("a", 0): ["end"], ("b", -1): ["start", "ask"], ("b", 0): ["ask"], ("b", 1): ["person"], ("b", 2): [], ("c", -1): ["start", "ask"], ("c", 0): ["person"], ("d", -1): ["start", "ask"], ("d", 0): ["person"], ("e", -1): ["start", "ask"], ("e", 0): ["ask"], ("e", 1): ["end"]}
    assert got["a", 0]["slots"] == {"wish": "the FEE please"} and got["a", 0]["finished"] and not got["a", 0]["handed_off"] and got["b", 1]["handed_off"]
    loop = [dict(n, next_node="start") if n["node_id"] == "start" else n for n in nodes]
    end = D.played(spark.createDataFrame(rows[:1], "session_id string, seq int, text string, intent string"), loop, "start").where("seq = -1").first()
    assert [s["node_id"] for s in end["said"]] == ["__fallback__"] and end["handed_off"]


def test_scenarios(spark):
    frame, _ = _nodes(spark)
    scenarios = spark.createDataFrame([("s", "start", "")], "scenario string, entry_node string, fallback_node string")
    assert D.scenario_problems(scenarios, frame).count() == 0
    bad, _ = _nodes(spark, [dict(node_id="odd", kind="ask", next_node="nowhere", intents=[dict(name="i", patterns=["("], next_node="")]), dict(node_id="odder", kind="ask", reprompt="r")])
    wrong = spark.createDataFrame([("s", "end", "lost")], "scenario string, entry_node string, fallback_node string")
    assert _rows(D.scenario_problems(wrong, bad), "node_id", "problem") == [("", "no way to a person"), ("lost", "no fallback node"), ("odd", "ask without reprompt"), ("odd", "no target of next"), ("odd", "pattern of i"), ("odder", "ask without intents")]
    more = D.cloned(frame, "s", ["start", "ask"], "_2").where("node_id like '%_2'").collect()
    assert {r["node_id"]: r["next_node"] for r in more} == {"start_2": "ask_2", "ask_2": "fork"}
    for bad_call in (("s", ["start"], ""), ("s", ["none"], "_2"), ("s", ["ask"], "")):
        with pytest.raises(ValueError):
            D.cloned(frame, *bad_call)
    steps = spark.createDataFrame([("draft", "built"), ("draft", "live"), ("live", "live"), ("built", "draft")], "a string, b string")
    assert [r[0] for r in steps.select(D.promotion_fault(F.col("a"), F.col("b"))).collect()] == [None, "not the next stage", "already there", "not the next stage"]


def test_files(spark, tmp_path):
    at = lambda name, data: (tmp_path / name).parent.mkdir(parents=True, exist_ok=True) or ((tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode()) and None) or str(tmp_path / name)
    path = at("g/tts.jsonl", '{"_kind": "tts"}\n\n{"case_id": "1", "text": "3개", "expect": "세 개"}\n')
    assert [tuple(r) for r in S.golden(spark, path, "tts").collect()] == [("1", "3개", "세 개")]
    with pytest.raises(Exception, match="tts2.jsonl:2 lacks expect"):
        S.golden(spark, at("g/tts2.jsonl", '{"_kind": "tts"}\n{"case_id": "1", "text": "x"}'), "tts").collect()
    corpus = at("m.md", "before\n## A-1 First one\nline\n\nmore\n## A-2 Second\nx\n")
    assert _rows(S.articles(spark, corpus), "doc_id", "title", "text") == [("A-1", "A-1 First one", "line\n\nmore"), ("A-2", "A-2 Second", "x")]

    def archive(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries.items():
                z.writestr(name, data)
        return out.getvalue()

    docx = archive({"word/document.xml": "<w:d xmlns:w='u'><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:d>", "word/header1.xml": "<h/>"})
    hwpx = archive({"Contents/section1.xml": "<s><p><t>b</t></p></s>", "Contents/section0.xml": "<s><p><t>a</t></p></s>"})
    files = [("a.txt", "plain".encode()), ("b.txt", "한글 문서".encode("cp949")), ("c.docx", docx), ("d", hwpx), ("e.pdf", b"%PDF-1"), ("f.txt", b" "), ("g.docx", b"PK broken")]
    got = {r["path"]: r for r in S.parsed(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary")).collect()}
    assert {n: r["text"] for n, r in got.items()} == {"a.txt": "plain", "b.txt": "한글 문서", "c.docx": "one two", "d": "a\nb", "e.pdf": None, "f.txt": None, "g.docx": None}
    assert got["b.txt"]["warning"] == "read as cp949" and got["c.docx"]["warning"] and got["d"]["kind"] == "hwpx" and got["g.docx"]["error"]
    from parlance.operators.audio import wav

    at("w/a.wav", wav(b"\1\0\2\0", 8000))
    assert [(r["rate"], bytes(r["pcm"])) for r in S.wav_files(spark, str(tmp_path / "w")).collect()] == [(8000, b"\1\0\2\0")]
    assert S.checksums(spark, str(tmp_path / "w")).first()["length"] == 48
    records = spark.createDataFrame([(1, T0, "x"), (2, datetime(2024, 1, 2), "y")], "seq_no long, recorded_at timestamp, body string")
    for _ in range(2):  # the second time is a job done again
        S.write_segments(records.limit(1), str(tmp_path / "audit"), "first")
        S.write_segments(records.where("seq_no = 2"), str(tmp_path / "audit"), "second")
    at("audit/segment=audit-20240102.jsonl/part-x.json", "no json\n")
    good, bad = S.read_segments(spark, str(tmp_path / "audit"), "seq_no long, recorded_at timestamp, body string")
    assert _rows(good, "seq_no", "segment") == [(1, "audit-20240101.jsonl"), (2, "audit-20240102.jsonl")] and bad.count() == 1
    frame, _ = _nodes(spark)
    wide = F.transform("intents", lambda i: F.struct(i["name"].alias("name"), F.lit('say "x", y').alias("description"), i["patterns"].alias("patterns"), F.array(F.lit("e1"), F.lit("e2")).alias("examples"), i["next_node"].alias("next_node"), F.lit("").alias("slot")))
    lines = S.intents_csv(frame.select("node_id", wide.alias("intents"))).orderBy("node_id", "place").collect()
    csv = at("i.csv", b"\xef\xbb\xbf" + "\r\n".join([",".join(S.INTENT_COLUMNS), *(r["line"] for r in lines)]).encode())
    back = {r["node_id"]: r["intents"] for r in S.read_intents(spark, csv, frame).collect()}
    assert [i["name"] for i in back["ask"]] == ["fee", "agent"] and back["ask"][0]["description"] == 'say "x", y' and back["ask"][0]["examples"] == ["e1", "e2"]
    with pytest.raises(ValueError):
        S.read_intents(spark, at("j.csv", "node_id,name\nx,y\n"))
    S.write_summaries(spark.createDataFrame([("t", T0, "s1", "old"), ("u", T0, "s2", "x")], "tenant_id string, created_at timestamp, session_id string, text string"), str(tmp_path / "sums"))
    S.write_summaries(spark.createDataFrame([("t", datetime(2024, 1, 3), "s1", "new")], "tenant_id string, created_at timestamp, session_id string, text string"), str(tmp_path / "sums"))
    assert _rows(S.newest_summaries(S.summaries(spark, str(tmp_path / "sums")), "t", 5), "session_id", "text") == [("s1", "new")]
    base = at("b.json", json.dumps({"note": "", "suites": {"a": {"mrr": 0.5, "total": 3}}}, indent=1))
    assert _rows(S.baseline(spark, base), "suite", "metric", "value") == [("a", "mrr", 0.5), ("a", "total", 3.0)]


def test_texts_of_models(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    names = F.array(F.lit("fee"), F.lit("agent"))
    assert [one(T.choice(F.lit(t), names)) for t in (' "fee"\nbecause', "it is agent.", "fee or agent", "none", "", "other")] == ["fee", "agent", None, None, None, None]
    assert one(T.first_declared([F.lit(None).cast("string"), F.lit("x"), F.lit("fee"), F.lit("agent")], names)) == "fee"
    intents = F.from_json(F.lit('[{"name":"a","patterns":["^no"]},{"name":"b","patterns":["x","FEE"]}]'), "array<struct<name:string,patterns:array<string>>>")
    assert one(T.first_intent(F.lit("the fee"), intents)) == "b" and one(T.first_intent(F.lit("zzz"), intents)) is None
    assert one(T.corrected(F.lit("무배담 행복 플러스 가입"), [("무배당 행복플러스", ("무배담행복플러스",)), ("행복플러스", ()), ("", ("x",))])) == "무배당 행복플러스 가입"
    assert T.recognition_prompt(["a" * 100, "b" * 90, "c" * 50]) == "a" * 100 + ", " + "b" * 90
    call = one(T.summary_fields(F.lit('```json\n{"category": " x ", "follow_up": null, "keywords": ["a", " ", "b"], "resolution": 5}\n```')))
    assert tuple(call) == ("x", "", "", "", "5", "", ["a", "b"])
    blank = lambda raw, keys, kind="call": one(T.blank_summary(T.summary_fields(F.lit(raw), kind), keys))
    assert not blank('{"category":"x"}', T.CALL_KEYS) and blank("{}", T.CALL_KEYS) and blank('{"follow_up":"x"}', T.CALL_KEYS) and blank("nothing", T.MEETING_KEYS, "meeting") and not blank('{"agenda":"one"}', T.MEETING_KEYS, "meeting")
    meeting = one(T.summary_fields(F.lit('{"title":"t","agenda":"only","decisions":["d",""],"action_items":["a",{"text":"b","owner":"o"},{"owner":"x"},null]}'), "meeting"))
    assert (meeting["title"], meeting["agenda"], meeting["decisions"], [tuple(i) for i in meeting["action_items"]], meeting["participants"]) == ("t", ["only"], ["d"], [("a", "", ""), ("b", "o", "")], [])
    assert one(T.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("한")))) == '{"a":"한","b":"1"}' and one(T.trimmed(F.lit("x" * 300))) == "(300 chars)"
    assert [one(T.pattern_fault(F.lit(p))) for p in ("a+", " ", "x" * 501, "a*")] == [None, "blank", "too long", "matches everything"]
