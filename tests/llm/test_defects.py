import pytest

from threadloom.llm.defects import Prompt, align, common_subsequence, defects, is_refusal
from threadloom.llm.languages import LanguageModel, train

BODY = "<p>The cache returns stale rows when the primary node restarts, and I do not understand which setting controls that behaviour on this version.</p><pre><code>x = load(a, 3)</code></pre>"
SAMPLES = {
    "en": ["The server keeps all values in memory until the process ends, and then they are written to the disk in one step.", "When you change the setting, every worker has to read the file again before it can answer.", "Is there a way to find out which of these two commands is slower on this machine?", "Set the flag and restart the node, then check that the old rows are gone."],
    "de": ["Der Dienst hält alle Werte im Speicher, bis der Prozess endet, und dann werden sie in einem Schritt auf die Platte geschrieben.", "Wenn man die Einstellung ändert, muss jeder Arbeiter die Datei noch einmal lesen, sonst bleibt der alte Stand stehen.", "Gibt es einen Weg, um zuerst den langsamen Befehl zu finden und nicht neu zu starten?", "Man kann den Knoten anhalten und danach die Zeilen löschen."],
    "ru": ["Сервер держит все значения в памяти, пока процесс не закончится.", "Если изменить настройку, каждый узел должен прочитать файл ещё раз.", "Попробуйте сначала удалить старые строки."],
    "ja": ["サーバーはすべての値をメモリに保持します。", "設定を変更すると、ファイルをもう一度読む必要があります。", "まず部品を確認してください。"],
}
MODEL = LanguageModel(SAMPLES)


def defect(body, prompt):
    return defects([body], [prompt], MODEL)[0]


PROMPT = Prompt("Why does the cache return stale rows after a restart?", BODY)


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (None, "empty"), ("", "empty"), ("<p>&nbsp;​</p><!-- x -->", "empty"), ("<p>I'm sorry, but I can't help with this request.</p>", "refusal"), ("<p>Hello, I must decline to comment on caches. Please consult a professional.</p>", "refusal"), ("<p>Lo siento, no puedo ayudar con eso.</p>", "refusal"), ("<p>Dabei kann ich leider nicht helfen.</p>", "refusal"),
        ("<p>You can't, the node is slow.</p>", None), ("<p>Yes, since 1.17.</p>", None), ("<p>I can't say which is best. Set the flag and restart the node, then it works for me.</p>", None), ("<p>Why does the cache return stale rows after a restart?</p>", "copy"), ("<p>Your question was: Why does the cache return stale rows after a restart?</p>", "copy"), (BODY, "copy"), (BODY.upper().replace("<PRE>", "<pre>"), "copy"),
        ("<p>Man muss zuerst den Knoten anhalten, sonst bleibt der alte Speicher stehen und die Zeilen sind nicht neu.</p>", "language"), ("<p>Попробуйте сначала остановить узел и удалить файл.</p>", "language"), ("<p>まず部品を確認する必要があります。</p>", "language"), ("<p>Set the flag and restart the node, then the", "truncated"), ("<p>Set the flag and restart the no</p>", "truncated"), ("<p>Do this.</p><pre><code>x = load(a", "truncated"),
        ("<p>Set the flag.</p>\n<p>HTH</p>", None), ("<p>Do this:</p><ul><li>set the flag</li></ul>", None), ("<p>Set it.</p><pre><code>x = load(b, 4)\n</code></pre>", None), ("<p>Restart the node.</p>" * 3000, None),
    ],
)
def test_defects(body, expected):
    assert defect(body, PROMPT) == expected


def test_refusal_with_an_answer_is_none():
    assert not is_refusal("Sorry, I am not able to reproduce this. Set the flag to 3.")


def test_subsequence():
    assert common_subsequence(list("abcbdab"), list("bdcaba"))[-1] == 4
    assert common_subsequence([], ["a"]) == [] and common_subsequence(["a"], []) == [0]


def test_pairs(spark, make):
    from threadloom.llm.defects import broken_pairs

    labelled = spark.createDataFrame([(k, x) for k, xs in SAMPLES.items() for x in xs] + [(None, "x" * 50), ("und", "x" * 50), ("en", None)], "lang string, text string")
    assert train(labelled).names == ["de", "en", "ja", "ru"] and train(labelled.where("false")).names == []

    q = dict(id="1", post_type_id="1", title="Why?", body=BODY)
    posts = make["posts"](q, q, dict(id="2", post_type_id="2", parent_id=" 01", body=None), dict(id="2", post_type_id="2", parent_id=" 01", body=None), dict(id="3", post_type_id="2", parent_id="1", body="<p>Restart the node.</p>"), dict(id="4", post_type_id="2", parent_id="9", body=None), dict(id="5", post_type_id="2", body=None), dict(id="6", post_type_id="2", parent_id="7", body="<p>Fine.</p>"), dict(id="7", post_type_id="1"))
    assert [tuple(r) for r in broken_pairs(posts, labelled).collect()] == [(2, "empty")]
    assert broken_pairs(posts.where("false"), labelled.where("false")).count() == 0


def test_a_long_refusal_is_one():
    wordy = "I'm sorry, but I can't help with this request. Please consult a professional about it. Thank you for your understanding and patience. I hope you understand. If you have any other questions, feel free to ask. "
    assert is_refusal(wordy * 3) and defect(f"<p>{wordy * 3}</p>", PROMPT) == "refusal"
    assert not is_refusal(wordy * 3 + "Set the flag to 3.")


def test_alignment():
    template = [frozenset({"SELF"}), frozenset({"CANNOT"}), frozenset({"help"})]
    assert align("sorry i really can not possibly help".split(), template) and align("we won t help".split(), template)
    assert not align("i help you can not".split(), template) and not align("i can not".split(), template) and not align([], template)
    assert not align(["i", "cannot", *["x"] * 9, "help"], template)


def test_languages_of_batches():
    texts = ["", "123", *(x for xs in SAMPLES.values() for x in xs)]
    one = [MODEL.rate([t]) for t in texts]
    sums, n = MODEL.rate(texts)
    assert all((abs(a - sums[i]) < 1e-3).all() and b[0] == n[i] for i, (a, b) in enumerate(one))
    assert MODEL.differ(texts[:2], texts[2:4]) == [False, False] and LanguageModel({}).differ(["a"], ["b"]) == [False]
