"""Training-text operators take in the whole of their input."""

import pytest

from weftspark.llm import leaks, pii, survivor


def test_truth_knows_files_and_all_fields_and_converges(spark):
    data = []
    for g in range(40):
        # files of one folder; the bad one's errors sort first
        for src, right in (("good", True), ("fair", g % 8 != 0), ("bad", g % 5 == 0)):
            props = [{"b": "1", "a": "2"}, {"a": "2", "b": "1"}][g % 2] if right else {"a": src}
            data.append((len(data), f"s{g}", "P", f"o{g}", None, None, 0.8 if right else {"fair": 0.7, "bad": 0.75}[src], f"x-right{g}" if right else f"wrong-{src}{g}", props, f"docs/{src}", 1))
    t = spark.createDataFrame(data, "triple_id long, subject_id string, predicate string, object_id string, subject_label string, object_label string, confidence double, source_span string, properties map<string,string>, source_file string, extraction_tier int")
    got = {}
    for r in survivor.truth(t).collect():
        got.setdefault(r.field, []).append(r.value)
    assert set(got) == {"subject_id", "predicate", "object_id", "confidence", "source_span", "properties"}
    assert all(v.startswith("x-right") for v in got["source_span"]) and set(got["properties"]) == {'{"a":"2","b":"1"}'} and set(got["confidence"]) == {"0.8"}
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        survivor.truth(t, rounds=1)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("au 12 rue\nde la Paix.", "address"), ("au 12 rue\u00a0de la Paix.", "address"), ("au 7 quai\tVoltaire.", "address"),
        ("dort, Kastanienring\n5.", "address"), ("dort, Lindenhof\u00a05.", "address"), ("dort, Am\nMarkstein 5.", "address"),
        ("at 12 Maple Ter, now", "address"), ("to bo.li [At] weft.org now", "email"), ("to bo.li [aT  ] weft.org now", "email"),
    ],
)
def test_no_filter_before_a_pattern_is_narrower_than_it(text, kind):
    assert [k for *_, k in pii.Finder([], []).find(text)] == [kind]


def test_leaks_in_fields_of_a_least_passage_with_a_word_dropped():
    words = [f"w{i}" for i in range(30)]
    index = leaks.Index([("a", " ".join(words)), ("b", " ".join(f"z{i}" for i in range(20)))])
    passage = words[9:21]
    dropped = [" ".join(passage[:k] + passage[k + 1 :]) for k in range(12)]
    # without an end word 11 words are left, which are no passage
    assert leaks.leaks(dropped, index) == [set(), *[{"a"}] * 10, set()]
    changed = " ".join([*passage[:4], "new", *passage[6:]])
    assert leaks.leaks([changed, None, ""], index) == [set()] * 3
