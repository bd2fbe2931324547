import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.llm import canonical, defects, lang, leaks, mixing, packing, pii, splitting, survivor, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- leaks ------------------------------------------------------------------------------------------------------------


def naive(record, item):
    """Any passage, by plain edit distance of all pieces of the item against all pieces of the record with matching ends."""
    n, m = len(item), len(record)
    for i in range(n):
        for j in range(m):
            if item[i] != record[j]:
                continue
            # distances from (i, j) on
            prev = list(range(m - j + 1))
            for a in range(1, n - i + 1):
                row = [a]
                for b in range(1, m - j + 1):
                    row.append(min(prev[b] + 1, row[-1] + 1, prev[b - 1] + (item[i + a - 1] != record[j + b - 1])))
                prev = row
                if a >= 12 and any(prev[b] * 8 <= a and item[i + a - 1] == record[j + b - 1] for b in range(1, m - j + 1)):
                    return True
    return False


def test_passages_against_edit_distance():
    rng = random.Random(5)
    seen = [0, 0]
    for _ in range(250):
        item = [rng.randrange(1, 40) for _ in range(rng.randrange(12, 26))]
        part = item[rng.randrange(0, 6) :][: rng.randrange(8, 24)]
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + [99] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + [98] + part[k:]])
        record = [rng.randrange(50, 60) for _ in range(5)] + part + [rng.randrange(50, 60) for _ in range(5)]
        want = naive(record, item)
        seen[want] += 1
        assert leaks.passage([w if w < 50 else 0 for w in record], item) == want
    assert min(seen) > 40


def test_buckets_find_windows():
    rng = np.random.default_rng(3)
    w = rng.integers(1, 5000, size=(2000, 12))
    assert leaks.recall(w, w) == 1.0
    one = w.copy()
    one[np.arange(2000), rng.integers(0, 12, 2000)] = 9999
    assert leaks.recall(w, one) > 0.95
    gone = np.stack([np.append(np.delete(x, rng.integers(0, 12)), 7777) for x in w])
    assert leaks.recall(w, gone) > 0.9
    assert leaks.recall(w, rng.integers(5001, 9000, size=(2000, 12))) == 0.0


def test_leaks_query(spark):
    words = [f"term{i}" for i in range(40)]
    item = " ".join(words)
    bent = words[5:25]
    bent[7] = "other"
    docs = [
        (1, "Intro. " + ", ".join(words[3:16]).upper() + " end"), (2, " ".join(bent)), (3, " ".join(words[:11])), (4, None), (5, ""), (6, "<b>" + "</b> **".join(words[10:30]) + "**"), (7, " ".join(words[:10] + ["x", "y", "z"] + words[10:20])), (8, ("filler words " * 20000) + item), (1, "Intro. " + ", ".join(words[3:16]).upper() + " end"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame([(1, item, None), (2, None, "no"), (3, " ".join(words[:6]), " ".join(words[6:12]))], "qa_id long, question string, answer string")
    items = spark.createDataFrame([("A", item, "short answer"), ("B", None, None), (None, item, item)], "id string, query string, ground_truth_answer string")
    got = rows(leaks.find_leaks({"documents": (d, "doc_id", ("text",)), "qa_raw": (q, "qa_id", ("question", "answer"))}, items))
    assert got == [("documents", i, "A") for i in (1, 2, 6, 8)] + [("qa_raw", 1, "A")]
    assert leaks.find_leaks({"documents": (d, "doc_id", ("text",))}, items.limit(0)).count() == 0
    assert leaks.find_leaks({"documents": (d.limit(0), "doc_id", ("text",))}, items).count() == 0


def test_lost_punctuation():
    item = "Because ROUTE_ADJUST stays at 0.77, rx inherits 14 stale arcs from u_lsu52/issue_reg[24]. Lower SYNTH_EFFORT to 0.80, then stop."
    ix = leaks.Index([("A", item)])
    assert leaks.leaks([re.sub(r"[^\w\s]", "", item), item.replace("/", " "), "stays at 0.77", None], ix) == [{"A"}, {"A"}, set(), set()]


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    items = spark.createDataFrame([(str(k), " ".join(f"w{k}x{i}" for i in range(20)), None) for k in range(6)], "id string, query string, ground_truth_answer string")
    d = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(6)], "doc_id long, text string")
    assert leaks.find_leaks({"d": (d, "doc_id", ("text",))}, items).count() == 6


# --- canonical names ----------------------------------------------------------------------------------------------------


ENTITIES = [("d1", "design", "heron_cpu32", ["HRN-C32"]), ("d2", "design", "heron_cpu64", None), ("d3", "design", "plover_uart", None), ("d4", "design", "lumen_ddrphy", None), ("v1", "tool_version", "loomflow_v4.1", None), ("v2", "tool_version", "loomflow_v4.10", ["LO-4.10"]), ("v3", "tool_version", "loomflow_31Q1", None)]
TYPED = {
    "heron_cpu32": "d1", "HERON CPU32": "d1", "cpu64 heron": "d2", "Hreon-cpu64": "d2", "hrn c32": "d1", "rtl/heron_cpu32.v": "d1", "the Plover UART block": "d3", "pl0ver_uart": "d3", "plоver_uart": "d3", "ｈｅｒｏｎ＿ｃｐｕ３２": "d1", "heron​_cpu32": "d1", "HeronCpu64": "d2", "lumen_ddrphy_top": "d4", "ddrphy lumen": "d4",
    "heron_cpu128": "UNMATCHED", "juniper_uart": "UNMATCHED", "testchip": "UNMATCHED", "???": "UNMATCHED", "heron_cpu": "UNMATCHED", "hrn d32": "UNMATCHED",
}
VERSIONS = {"LoomFlow 4.1": "v1", "loomflow 4.10+build.7": "v2", "loomflow_v4_1": "v1", "Lomflow v4.10": "v2", "lo-4.10": "v2", "31Q1 (LoomFlow)": "v3", "LoomFlow 31Q1-ga53d19a": "v3", "loomflow/V4.1": "v1", "loomflow 4.1.7": "UNMATCHED", "loomflow 21Q1": "UNMATCHED", "nightly": "UNMATCHED"}


def test_names(spark):
    e = spark.createDataFrame(ENTITIES, "entity_id string, kind string, canonical_name string, aliases array<string>")
    v = spark.createDataFrame([("design", x) for x in TYPED] + [("tool_version", x) for x in VERSIONS] + [("design", None), ("design", " "), (None, "x"), ("design", "heron_cpu32")], "kind string, value string").withColumn("score", F.lit(1))
    got = {(r.kind, r.value): r.entity_id for r in canonical.map_values(v, e).collect()}
    assert got == {("design", k): x for k, x in TYPED.items()} | {("tool_version", k): x for k, x in VERSIONS.items()}
    assert {r.entity_id for r in canonical.map_values(v, e.limit(0)).collect()} == {"UNMATCHED"}
    assert canonical.map_values(v.limit(0), e).count() == 0


def test_generated_typos(spark):
    rng = random.Random(9)
    names = [("d1", "heron_crypto"), ("d2", "plover_uart"), ("d3", "lumen_ddrphy"), ("d4", "gannet_codec"), ("d5", "thistle_retire")]
    e = spark.createDataFrame([(i, "design", n, None) for i, n in names], "entity_id string, kind string, canonical_name string, aliases array<string>")
    made = {}
    for i, n in names:
        for k in range(120):
            w = list(n)
            for _ in range(1 + k % 2):  # one or two edits
                p = rng.randrange(len(w) - 1)
                w[p : p + 2] = rng.choice([[w[p + 1], w[p]], [w[p]], [w[p], rng.choice("abcdefg"), w[p + 1]], [rng.choice("abcdefg"), w[p + 1]]])
            made["".join(w)] = i
    got = {r.value: r.entity_id for r in canonical.map_values(spark.createDataFrame([("design", v) for v in made], "kind string, value string"), e).collect()}
    right = sum(got[v] == i for v, i in made.items())
    wrong = sum(got[v] not in (i, "UNMATCHED") for v, i in made.items())
    assert right > 0.97 * len(made) and wrong == 0, (right, wrong, len(made))


def test_fields(spark):
    e = spark.createDataFrame(ENTITIES, "entity_id string, kind string, canonical_name string, aliases array<string>")
    t = spark.createDataFrame([(1, "heron_cpu32", "Design", "HERON_CPU32", "Design"), (2, "HERON", "Module", "LoomFlow 4.1", "Version"), (3, None, "Design", " ", "Version")], "triple_id long, subject_id string, subject_label string, object_id string, object_label string")
    m = spark.createDataFrame([("a", "plover uart", None), ("a", "plover uart", None), (None, None, "nightly")], "artifact_id string, design_name string, tool_version string")
    assert rows(canonical.map_fields(t, m, m.limit(0), e)) == [("manifest", "a", "design_name", "d3"), ("manifest", None, "tool_version", "UNMATCHED"), ("triples", "1", "object_id", "d1"), ("triples", "2", "object_id", "v1")]


def test_edits():
    assert canonical.edits("abcd", "abdc") == 1 and canonical.edits("", "ab") == 2 and canonical.edits("kitten", "sitting") == 3


# --- survivors ----------------------------------------------------------------------------------------------------------


TRIPLE = "triple_id long, subject_id string, predicate string, object_id string, subject_label string, object_label string, confidence double, extracted_at timestamp, source_span string, properties map<string,string>, source_file string, extraction_tier int, group_id int"
T1, T2 = datetime(2031, 1, 1), datetime(2031, 1, 2)


def test_survivors(spark):
    data = [
        (5, "A b", "P", "o_1", None, None, 0.5, T1, "s5", {"a": "1"}, "x/f", 1, 0), (3, "a-B", "p", "O1", None, None, 0.9, T1, " ", None, "y/f", 1, 0), (4, "ab", "P", "o1", None, None, 0.9, T2, None, {}, "x/f", 1, 0),
        (7, "z", "P", "o", None, None, None, None, None, None, None, None, 0), (8, "Z", "P", "o", None, None, None, None, "", {}, None, None, 0), (9, None, "P", "o", None, None, 1.0, T1, "s", None, "f", 1, 0), (10, None, "P", "o", None, None, 1.0, T1, "s", None, "f", 1, 0), (11, "single", "P", "o", None, None, 1.0, T1, "s", None, "f", 1, 0),
        (12, "n", "P", "q", None, None, float("nan"), T1, None, None, "f", 1, 0), (13, "n", "P", "q", None, None, 0.1, T1, None, None, "f", 1, 0),
    ]
    df = spark.createDataFrame(data, TRIPLE)
    assert rows(survivor.provenance(df)) == sorted([(3, "record", 4), (3, "source_span", 5), (3, "properties", 5), (7, "record", 7), (12, "record", 13)], key=str)
    one = survivor.survivors(df).where("group_id = 3").first()
    assert one.source_span == "s5" and one.properties == {"a": "1"} and one.record_from == 4
    assert survivor.provenance(df.limit(0)).count() == 0
    t = {(r.group_id, r.field): r.value for r in survivor.truth(df).collect()}
    assert t[3, "source_span"] == "s5" and t[7, "subject_id"] in ("z", "Z")
    assert survivor.truth(df.limit(0)).count() == 0


def test_truth_trusts_reliable_sources(spark):
    data, i = [], 0
    for g in range(60):
        for src, right in (("good", True), ("fair", g % 10 != 0), ("bad", g % 4 == 0), ("worse", g % 5 == 0)):
            i += 1
            data.append((i, f"s{g}", "P", f"o{g}", None, None, 0.8, T1, f"right{g}" if right else f"wrong{g}", None, f"{src}/f", 1, 0))
    got = [r.value for r in survivor.truth(spark.createDataFrame(data, TRIPLE)).where("field = 'source_span'").collect()]
    assert sum(v.startswith("right") for v in got) >= 57


# --- splitting ----------------------------------------------------------------------------------------------------------


def test_split_properties():
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "End. Next ", "\n", "\r\n", "\n\n", "module x;\n", "# Head\n", "z" * 300, "日本。", "[INFO] a\n"]) for _ in range(rng.randrange(1, 400)))
        p = splitting.split(t, 64, 8)
        assert "".join(t[f:e] for _, f, e, _ in p) == t
        assert all(splitting.tokens(e - s) <= 64 and s <= f <= e and splitting.tokens(max(1, f - s)) <= 8 for s, f, e, _ in p)
        assert all(a[2] == b[1] for a, b in zip(p, p[1:], strict=False))
    assert splitting.split("") == [(0, 0, 0, "end")] and len(splitting.split("a" * 2051)) == 1 and len(splitting.split("a" * 2052)) == 2


def test_valleys():
    a, b = "the clock tree has slack and skew on every clock path.\n", "metal spacing rules forbid narrow vias under metal straps.\n"
    t = a * 30 + b * 25
    cut = splitting.split(t, 512, 0)[0][2]
    assert abs(cut - len(a) * 30) <= 2 * len(a)
    # by hand: word counts, blocks of BLOCK units, smoothing, rise to the next peaks
    text = "a b. a c. b b. x y. y z. x z. "
    cuts = [5, 10, 15, 20, 25]
    units = [Counter(text[i:j].replace(".", "").split()) for i, j in zip([0, *cuts], [*cuts, len(text)])]
    def cos(i):
        l, r = sum(units[max(0, i + 1 - splitting.BLOCK) : i + 1], Counter()), sum(units[i + 1 : i + 1 + splitting.BLOCK], Counter())
        return sum(l[w] * r[w] for w in l) / (sum(v * v for v in l.values()) * sum(v * v for v in r.values())) ** 0.5
    s = [cos(i) for i in range(5)]
    s = [(s[max(0, i - 1)] + 2 * s[i] + s[min(4, i + 1)]) / 4 for i in range(5)]
    def peak(i, step):
        while 0 <= i + step < 5 and s[i + step] >= s[i]:
            i += step
        return s[i]
    want = [peak(i, -1) + peak(i, 1) - 2 * s[i] for i in range(5)]
    assert splitting.depths(text, cuts) == pytest.approx(want) and max(range(5), key=want.__getitem__) == 2


CHUNK = "chunk_id string, source_file string, chunk_index int, text string, token_count int, embedded_at timestamp, p int"


def test_pieces(spark):
    big = "Sentence one is here. " * 300
    c = spark.createDataFrame([("a", "f", 3, big, 1, T1, 0), ("a", "f", 3, big, 1, T2, 0), ("b", "f", 1, "small", None, T1, 0), ("c", "g", None, None, 1, T1, 0), ("d", None, 0, "", 1, T1, 0), ("e", "f", 900, "x" * 3000, 1, T1, 0)], CHUNK)
    p = splitting.pieces(c).orderBy("source_file", "new_chunk_index").collect()
    f = [r for r in p if r.source_file == "f"]
    assert [r.new_chunk_index for r in f] == list(range(len(f))) and f[0].chunk_id == "b" and f[-1].chunk_id == "e"
    assert "".join(r.text[r.fresh - r.start :] for r in f if r.chunk_id == "a") == big and max(r.token_count for r in p) <= 512
    assert {r.chunk_id for r in p} == {"a", "b", "d", "e"}
    assert splitting.pieces(c.limit(0)).count() == 0


# --- defects ------------------------------------------------------------------------------------------------------------


Q = "Why does Tessera 2.4.0 report 18 violations on met2 after routing of heron_cpu32?"
CASES = [
    ("", "empty"), (None, "empty"), (" \n", "empty"), ("N/A", "empty"), ("<answer>", "empty"), ("[no answer]", "empty"), ("...", "empty"), ("​", "empty"), ("None.", "empty"),
    (Q, "copies_question"), (Q.upper(), "copies_question"), ("You asked: " + Q, "copies_question"), (Q + " " + Q, "copies_question"), (f'"{Q[:-1]}."', "copies_question"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("As an AI assistant I am not able to give advice on this.", "refusal"), ("Diese Frage kann ich leider nicht beantworten.", "refusal"), ("Je ne suis pas autorisé à commenter ces règles.", "refusal"), ("Lo siento, no puedo ayudar con esta solicitud.", "refusal"), ("I must decline to answer. Please ask your foundry contact.", "refusal"), ("Mi dispiace, non posso rispondere a questa domanda.", "refusal"), ("申し訳ありませんが、そのご質問にはお答えできません。", "refusal"), ("К сожалению, я не могу ответить на этот вопрос.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"),
    ("The pins overlap. Keep the aspect ratio near,", "truncated"), ("The pins overlap. Resizing invx4 to the next drive the", "truncated"), ("Steps:\n1. Rerun routing with A=0.5\n2. Check the units\n3.", "truncated"), ("Look here.\n\n```\nset_max_fanout 24 [current_design]", "truncated"), ("Bad.\n\nThe faulty text is:\ncreate_clock -period 4.16 -name perf_cl", "truncated"),
    ("Der kritische Pfad beginnt bei u_rx1 und endet bei u_tx2. Bitte prüfen Sie zuerst die Einheit.", "other_language"), ("Le chemin critique part de u_rx1 et aboutit à u_tx2. La cause est une contrainte absente dans le fichier.", "other_language"),
    ("Macro tx is rotated and blocks the met4 tracks.", None), ("Use 0.33 instead.", None), ("Steps:\n1. Rerun routing before you look at anything else\n2. Check the units first", None), ("It is low.\n\n```\nset_max_fanout 24 [current_design]\n```", None), ("Power is high. Then run: make tx_cts", None), ("Bad.\n\nThe faulty text is:\nLAYER via2 ;\n  SPACING 3.692 ;", None),
    ("I cannot reproduce this with Sylvane 32Q1, but the cause is visible in the report.", None), ("It is not possible to legalise dffqx2 at (61, 76), so move it.", None), ("The router cannot help here because via2 is full.", None), (Q + " The strap on met2 is too wide.", None), ('The message "Nach dem Schritt floorplan verletzt das Netz noch die Regel" comes from the local wrapper.', None),
]


CASES += [
    ("Критический путь начинается в u_rx1 и заканчивается в u_tx2.", "other_language"), ("关键路径从 u_rx1 开始，到 u_tx2 结束，请先检查单位。", "other_language"), ("المسار الحرج يبدأ عند u_rx1 وينتهي عند u_tx2.", "other_language"), ("クリティカルパスはu_rx1から始まります。まず単位を確認してください。", "other_language"),
]


@pytest.mark.parametrize("answer,want", CASES)
def test_defects(answer, want):
    d = defects.defects(Q, answer, "LAYER via2 ;\n  SPACING 3.692 ;" if answer and "via2 ;" in answer else None, "-.[]" if answer and "create_clock" in answer else None)
    assert (d[0] if d else None) == want


def test_flag_pairs(spark):
    df = spark.createDataFrame([(1, Q, "N/A", None), (2, Q, "Fine.", ""), (3, None, "Fine, but", None), (4, None, None, None), (1, Q, "N/A", None), (5, Q, "word " * 40000 + "end.", None)], "qa_id long, question string, answer string, evidence_span string").withColumn("defects", F.lit(1))
    assert rows(defects.flag_pairs(df).select("qa_id", "defect").distinct()) == [(1, "empty"), (3, "truncated"), (4, "empty")]
    assert defects.flag_pairs(df.limit(0)).count() == 0


def test_question_language_is_that_of_what_is_asked():
    q = "Lower the effort, because the strap on met2 is too wide and the pins are near the edge. Comment corriger la violation dans le bloc ?"
    assert defects.defects(q, "Le chemin critique part de u_rx1 et aboutit à u_tx2. Il faut relancer le flot.", None) == []
    assert defects.defects(q, "The strap on met2 is too wide, so that the router has no track left there.", None) == ["other_language"]
    assert defects.defects("ok?", "Критический путь начинается в u_rx1 и заканчивается в u_tx2.", None) == ["other_language"]


def test_statements_are_learned(spark):
    ev = [f"knob A{i}={i}\nother {i}" for i in range(30)] + [None, ""]
    p = spark.createDataFrame([(i, "What is it?", "Bad.\n\nThe faulty text is:\nknob A7", e) for i, e in enumerate(ev)], "qa_id long, question string, answer string, evidence_span string")
    assert {r.head: r.marks for r in defects.statement_marks(p, "evidence_span").collect()} == {"knob": "="}
    assert {r.qa_id for r in defects.flag_pairs(p).where("defect = 'truncated'").collect()} >= {30, 31}
    assert defects.defects("What is it?", "Bad.\n\nThe faulty text is:\nknob A7", None) == []


def test_language():
    assert lang.detect("The die spans (1, 2) to (3, 4) and the clock is fast.") == "en" and lang.detect("まずライブラリの時間単位を確認してください。") == "ja"
    assert lang.detect("") is None and lang.detect(None) is None and lang.normalise("en-US") == "en" and lang.normalise("DE") == "de" and lang.normalise("spa") == "es" and lang.normalise("xx") is None


# --- tokens, packing, mixing ---------------------------------------------------------------------------------------------


def test_tokens(spark):
    t = "Clock skew of 12.5 ps  on u_rx/reg[3]\n\nまず確認。 isn't it? " * 40
    assert len(tokens.parts(t, 1000)) > 1 and "".join(tokens.parts(t, 1000)) == t
    whole = tokens.lengths([t], tokens.TOKENIZER)[0]
    assert sum(tokens.lengths(tokens.parts(t, 1000), tokens.TOKENIZER)) == whole
    df = spark.createDataFrame([(t,), ("",), (None,)], "text string")
    assert [r.n for r in df.select(tokens.count_tokens(F.col("text")).alias("n")).collect()] == [whole, 0, None]


def test_cube(spark):
    docs = spark.createDataFrame([(1, "the clock is on", "en", "s", "a", "t0", "c", "x"), (2, "the rule is on", "xx", "s", None, "t1", "c", None), (3, None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, artifact_id string, source_type string, content_type string, topic string").withColumn("tokens", F.lit(1))
    man = spark.createDataFrame([("a", "m1", 7, datetime(2031, 1, 1).date()), ("a", "m2", None, datetime(2031, 1, 2).date()), (None, "m", 1, None)], "artifact_id string, source_type string, token_count int, scrape_date date")
    ch = spark.createDataFrame([("k", "log", 5, "a b"), ("k", "log", 5, "a b"), ("l", None, None, "c")], "chunk_id string, content_type string, token_count int, text string")
    got = tokens.token_cube(docs, man, ch).collect()
    top = {r.corpus: (r["items"], r.recorded_items, r.recorded_tokens) for r in got if r.level == 31}
    assert top == {"documents": (3, 0, 0), "chunks": (2, 1, 5)}
    assert {(r.source_type, r["items"]) for r in got if r.corpus == "documents" and r.level == 27} == {("m2", 1), ("t1", 1), (None, 1)}
    assert tokens.token_cube(docs.limit(0), man, ch.limit(0)).where("items > 0").count() == 0


def test_pack_properties():
    rng = random.Random(8)
    for n in (0, 1, 5, 400):
        sizes = [min(2048, max(0, int(rng.lognormvariate(5.5, 1)))) for _ in range(n)]
        boxes = packing.pack(sizes)
        assert sorted(i for b in boxes for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 2048 for b in boxes)
        if n == 400:
            assert sum(sizes) / (2048 * len(boxes)) > 0.97
    loads = [rng.randrange(1500, 2049) for _ in range(320)]
    g = packing.deal(loads, 32)
    t = [sum(x for x, k in zip(loads, g, strict=True) if k == i) for i in range(10)]
    assert max(t) - min(t) < 300 and [g.count(i) for i in range(10)] == [32] * 10


def test_containers(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([0, 3, 100, 700, 2048, 2049, 9000])) for i in range(300)] + [(900, None), (905, 10), (905, 10)]
    df = spark.createDataFrame(data, "doc_id long, tokens int")
    out = packing.containers(df, shard_tokens=60_000).collect()
    load, places = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.tokens
        places.setdefault(r.container, []).append(r.position)
    assert sum(r.tokens for r in out) == sum(n or 0 for _, n in data) and max(load.values()) <= 2048
    assert sorted(load) == list(range(len(load))) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(r.part == 0 for r in out if dict(data)[r.doc_id] is None or dict(data)[r.doc_id] <= 2048)
    assert len({r.doc_id for r in out}) == 302 and packing.containers(df.limit(0)).count() == 0


def test_budgets():
    g = mixing.budgets([("a", 0.5, 1, 100), ("b", 0.3, 2, 1000), ("c", 0.2, 5, 0)], 1000)
    assert g == {"a": 100, "b": 900, "c": 0}
    assert mixing.budgets([("a", 0.5, 1, 10), ("b", 0.5, 1, 10)], 1000) == {"a": 10, "b": 10} and mixing.budgets([], 10) == {}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    rng = random.Random(7)
    docs = [(i, "ab"[i % 5 == 0], rng.randrange(1, 400), rng.choice([0.5, 1.0, 2.0, None])) for i in range(1500)] + [(5000, None, 10, 1.0), (5001, "z", 100_000, 1.0), (5002, "a", None, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int, weight double")
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.5, 2), ("none", 0.1, 4), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, t)
    u, s = uses.collect(), {r.source: r for r in shares.collect()}
    total = sum(n or 0 for _, _, n, _ in docs)
    assert {r.source for r in u} == {"a", "b"} and max(r.uses for r in u if r.source == "b") <= 2
    for x in ("a", "b"):
        assert abs(s[x].used_tokens - s[x].budget_tokens) <= 400 and s[x].used_tokens == sum(r.tokens * r.uses for r in u if r.source == x)
    assert s["none"].used_tokens == 0 and s["a"].total_tokens == total
    # heavier documents are taken sooner
    plan = spark.createDataFrame([("a", 1.0, 1), ], "source string, target_share double, max_repeats int")
    half = spark.createDataFrame([(i, "a" if i < 4000 else "rest", 10, 4.0 if i % 2 else 1.0) for i in range(6000)], "doc_id long, source string, tokens int, weight double").where("doc_id < 4000 or doc_id >= 0")
    u2, _ = mixing.mix(half.withColumn("tokens", F.when(F.col("source") == "rest", 0).otherwise(F.col("tokens"))), plan)
    assert u2.where("uses = 1").count() == 4000
    e, z = mixing.mix(df.limit(0), t)
    assert e.count() == 0 and z.count() == 3


def test_weighted_choice(spark):
    d = spark.createDataFrame([(i, "a", 10, 4.0 if i % 2 else 1.0) for i in range(4000)] + [(i, "b", 10, 1.0) for i in range(4000, 5000)], "doc_id long, source string, tokens int, weight double")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 4)], "source string, target_share double, max_repeats int")
    u, s = mixing.mix(d, t)
    a = u.where("source = 'a' and uses = 1")
    heavy = a.where("doc_id % 2 = 1").count()
    assert s.where("source = 'b'").first().most_uses == 4 and heavy > 0.7 * a.count()


# --- personal information --------------------------------------------------------------------------------------------------


F0 = pii.Finder(["orla", "ana-lirio", "jürg"], ["quessard", "van der smeel", "o'brisk", "murenzi-lott"])
TEXTS = [
    ("Thanks, Orla Quessard", [("Orla Quessard", "name")]), ("As QUESSARD Orla said", [("QUESSARD Orla", "name")]), ("by Quessard, Orla on", [("Quessard, Orla", "name")]), ("by O. Quessard and Ana-Lirio B. Murenzi-Lott", [("O. Quessard", "name"), ("Ana-Lirio B. Murenzi-Lott", "name")]), ("Dr. Orla van der Smeel", [("Orla van der Smeel", "name")]), ("As N. O'Brisk pointed", [("N. O'Brisk", "name")]),
    ("The Quessard rule, Nightly Regression", []), ("担当は Jürg Quessard です。", [("Jürg Quessard", "name")]),
    ("mail o.quessard+x@eda.mail.example now", [("o.quessard+x@eda.mail.example", "email")]), ("at a [at] b.example.org.", [("a [at] b.example.org", "email")]), ("reachable at a dot b at lab dot example.", [("a dot b at lab dot example", "email")]), ("probe rx@tt_0p80v_25c and trunk@8831", []),
    ("Tel. +1-415-555-0127", [("+1-415-555-0127", "phone")]), ("(+49 (0)30 23125 014)", [("+49 (0)30 23125 014", "phone")]), ("call (303) 555-0189 x12", [("(303) 555-0189 x12", "phone")]), ("020 7946 0687, 0049-30-23125135", [("020 7946 0687", "phone"), ("0049-30-23125135", "phone")]), ("303.555.0138。", [("303.555.0138", "phone")]), ("Seed 4882572606, Ticket 39-37978, Build 1.1.7.6, 2031-01-02", []),
    ("ID 973-55-2548 and SSN 00 709 058 762", [("973-55-2548", "id_number"), ("00 709 058 762", "id_number")]), ("passport X68251045 or 00085290-A", [("X68251045", "id_number"), ("00085290-A", "id_number")]), ("tax number 923654840 of", [("923654840", "id_number")]), ("Seed 923654840 crashes; Node N5661129", []),
    ("at 693 Old Foundry Court, Apt 4C.", [("693 Old Foundry Court, Apt 4C", "address")]), ("geht an Kiebitzstraße 183b.", [("Kiebitzstraße 183b", "address")]), ("chez X, 47 bis, quai aux Tourbes.", [("47 bis, quai aux Tourbes", "address")]), ("Avenida de los Tejares, 131.", [("Avenida de los Tejares, 131", "address")]), ("Row 18 of the table, Lane 22 of the link", []),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_places(text, want):
    assert [(text[a:b], k) for a, b, k in F0.find(text)] == want


def replaced(text, finder=F0, key=b"k"):
    """One text alone: what draw() gives at the first salt."""
    out, at = ["", ""], 0
    for (k, s, e, v, who, words) in pii._spans(finder, text):
        new = pii.compose(k, v, [pii.draw(k, w, key, 0, 5) for w in words], key)
        out = [out[0] + text[at:s] + pii.placeholder(k, who, key), out[1] + text[at:s] + new]
        at = e
    return [x + text[at:] for x in out]


def test_replacement():
    t = "Orla Quessard <o@x.example> +1-415-555-0127; QUESSARD Orla, 973-55-2548 at 12 Tarn Street"
    red, sur = replaced(t)
    tags = re.findall(r"\[(\w+)-([0-9a-f]{16})\]", red)
    assert [k for k, _ in tags] == ["NAME", "EMAIL", "PHONE", "NAME", "ID_NUMBER", "ADDRESS"] and tags[0] == tags[3]
    assert replaced(t)[1] == sur != replaced(t, key=b"other")[1]
    assert not re.search("Orla|Quessard|415-555|973-55", sur, re.I) and re.search(r"\d{3}-\d{2}-\d{4}", sur) and re.search(r"\+1-\d-?", sur[:60] + "+1-4") and "Street" in sur
    given, family = re.match(r"(\w+) (\w+) <", sur).groups()
    assert f"{family.upper()} {given}," in sur


def test_initials_and_people():
    f = pii.Finder(["jane", "karl", "anna", "antje"], ["smith", "jones"])
    t = "J. Smith, K. Smith and A. Smith; Anna Smith; Jones, K. met Karl Jones"
    who = [x[4] for x in pii._spans(f, t)]
    assert len(set(who)) == 4 and who[2] == who[3] and who[4] == who[5] and who[0] != who[1]
    two = [x[4] for x in pii._spans(f, "A. Smith; Anna Smith; Antje Smith")]
    assert len(set(two)) == 3  # two names fit the initial: it stays apart
    sur = replaced("A. Smith of Anna Smith", f)[1]
    m = re.fullmatch(r"(\w)\. (\w+) of (\w+) (\w+)", sur)
    assert m and m[2] == m[4] and m[3][0] == m[1] and m[1] != "A"
    assert pii.feminine("anna") and not pii.feminine("karl") and pii.draw("name", "anna", b"k", 0, 5).endswith("a")
    assert all(0x400 <= ord(c) < 0x500 for c in pii.draw("name", "иван", b"k", 0, 5))


def test_surrogates_are_distinct(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(8000)}
    w = spark.createDataFrame([("name", n) for n in names] + [("phone", f"+1415555{i:04d}") for i in range(5000)], "kind string, entity string")
    got = pii.assign(w, b"k").collect()
    assert len(got) == len(names) + 5000 == len({(r.kind, r.drawn) for r in got}) and not {(r.kind, r.drawn) for r in got} & {(r.kind, r.entity) for r in got}
    assert {(r.kind, r.entity, r.drawn) for r in pii.assign(w, b"k").collect()} == {(r.kind, r.entity, r.drawn) for r in got}
    assert pii.assign(w.limit(0), b"k").count() == 0


def test_pii_query(spark):
    people = ["Orla Quessard", "Jürg Quessard", "Brisa Talvermo", "Orla Talvermo", "Nerio Quessard", "Nerio Talvermo"]
    docs = [(i, f"Report by {people[i % 6]} today.") for i in range(24)] + [(90, None), (91, ""), (92, "x " * 100000 + "Orla Quessard"), (0, f"Report by {people[0]} today.")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    g = spark.createDataFrame([("Orla",), ("Jürg",), ("Brisa",), (None,)], "given_name string")
    got = pii.find_places(d, g, 'k').collect()
    assert len(got) == 25 and {r.start_pos for r in got if r.doc_id < 90} == {10} and {r.start_pos for r in got if r.doc_id == 92} == {200000}
    assert pii.find_places(d.limit(0), g, 'k').count() == 0 and pii.find_places(d, g.limit(0), 'k').count() == 0
    r = {x.doc_id: x for x in pii.replace_places(d, g, 'k').collect()}
    assert r[90].redacted is None and r[91].redacted == "" and "Orla" not in r[0].redacted and r[0].places == 1
    with pytest.raises(ValueError):
        pii.surrogates(d, g, "")
    same = {x.surrogate for x in pii.replace_places(d, g, "k").collect() if x.doc_id in (0, 6, 12)}
    assert len(same) == 1  # one person, one surrogate in all texts


def test_large_lexicon_is_joined(spark, monkeypatch):
    people = ["Orla Quessard", "Jürg Quessard", "Brisa van der Talm", "Orla van der Talm", "Q. Quessard", "Quessard, Brisa"]
    d = spark.createDataFrame([(i, f"Report by {people[i % 6]} today, not Quessardville.") for i in range(24)] + [(90, None)], "doc_id long, text string")
    g = spark.createDataFrame([("Orla",), ("Jürg",), ("Brisa",)], "given_name string")
    want = rows(pii.find_places(d, g, "k"))
    monkeypatch.setattr(pii, "MAX_NAMES", 1)
    assert rows(pii.find_places(d, g, "k")) == want and len(want) == 24


def test_joined_lexicon_finds_the_same_in_odd_texts(spark, monkeypatch):
    odd = ["It is Jane Smith's report", "It is Jane Smith’s report", "Smith, Jane- said", "Smith Karl--who", "Brisa van der Talm's book", "Jane Jones' car", "担当は佐藤美咲です", "田中美咲さんと山田 太郎", "Smith" + " " * 44 + "Janet", "Smith Jane\u0301"]
    plain = ["by Karl Smith, Anna Jones", "by Jane Smith, Karl Jones", "Anna van der Talm met Karl van der Talm"]
    d = spark.createDataFrame(list(enumerate(odd + plain)), "doc_id long, text string")
    g = spark.createDataFrame([(x,) for x in ("Jane", "Karl", "Anna", "Brisa", "美咲", "太郎")], "given_name string")
    want = rows(pii.find_places(d, g, "k"))
    monkeypatch.setattr(pii, "MAX_NAMES", 0)
    assert rows(pii.find_places(d, g, "k")) == want and len(want) == 17


def test_names_that_a_text_may_hold():
    given = ["jane", "ana-lirio", "jürg", "josé", "美咲", "さくら", "o'neil"]
    family = ["smith", "smit", "smith-", "smith's", "o'brisk", "van der smeel", "smeel", "de la cruz", "murenzi-lott", "murenzi", "davis", "rose", "strauss", "i\u0307nan"]
    pieces = [*"Jane JANE Ana-Lirio Jürg José Jose\u0301 O’Neil 美咲 さくら 佐藤 田 Smith SMITH O'Brisk O’Brisk Van der Smeel de la Cruz Murenzi-Lott davis Rose Strauß STRAUSS I\u0307nan J. ' ’s - -- \u0301 , ・ . _ 1 @ は Janet".split(" "), "van der Smeel", "De La Cruz", "\n", "\u00a0", "\u3000", " " * 44]
    rng, places = random.Random(3), 0
    for _ in range(20000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(2, 8)))
        g, f = rng.sample(given, rng.randint(1, len(given))), rng.sample(family, rng.randint(1, len(family)))
        keys = pii.Finder.keys(text, max(map(len, g + f)))
        got = pii.Finder(g, f).find(text)
        assert pii.Finder(keys & {*g}, keys & {*f}).find(text) == got, text
        places += len(got)
    assert places > 500 and len(pii.Finder.keys("A" + "'" * 100000, 30)) == 30
