"""Broken prompt and response pairs (problem 2).

Each answer is joined with the question its parent_id names and gets at most one defect, tried in this order:
empty, refusal, copy, language, truncated.

* refusal: the tokens of the answer's sentences are aligned with refusal templates; it is one if some sentence declines
  and all others align with greetings, closings or referrals.
* copy: 3-word shingles of the answer that the question's title or body holds, then the longest common subsequence of
  words after a lead-in; nine tenths of the rest in the question's order make a copy.
* language: a character n-gram model trained from a bounded labelled sample rates the prose outside code of the answer
  against that of the question.
* truncated: an element is left open, or the last paragraph ends inside a sentence, or the last code line inside a
  bracket or quotation.

Null bodies are empty. Answers without a question come out nowhere; repeated rows give one row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import positive_id, reference_number
from threadloom.functions.text import visible_text, words
from threadloom.llm import languages
from threadloom.llm.languages import LanguageModel
from threadloom.operators.skew import skew_join

COPIED = 0.9
LEAD_IN = 8
LONG_RUN = 8
SHINGLE = 3
ROWS = 512  # answers rated together

# Refusals and what may stand beside them are recognized by aligning tokens with templates. A word in capitals is a class:
# any of its phrases matches it. "a/b" is a choice. Between two template tokens at most `GAP` others may stand, before the
# first at most LEAD. Fixed values, written from general knowledge of how people and assistants decline.
CLASSES = {
    "SELF": "i|we",
    "CANNOT": "can not|cannot|cant|can t|could not|couldn t|couldnt|am not able to|m not able to|im not able to|are not able to|am unable to|m unable to|im unable to|am not allowed to|m not allowed to|am not permitted to|m not permitted to|am not in a position to|m not in a position to|wont|won t|will not|would rather not|d rather not|prefer not to|would prefer not to|must decline to|have to decline to|need to decline to|must refuse to|have to refuse to|refuse to|decline to|do not feel comfortable|don t feel comfortable|am going to pass on|must pass on|have to pass on",
    "TASK": "help|assist|answer|answering|comment|discuss|provide|share|give|continue|do|support|advise|respond|engage|talk|go|explain|say|offer|tell|fulfil|fulfill|comply|write|address|take|reply|speak|cover|touch|show|produce|handle|process|complete|recommend|describe|look",
    "MUST": "must|have to|need to|will have to|ll have to|am going to|m going to|will|ll|would rather",
    "REFUSE": "decline|refuse|pass|stop|leave|end|keep out|keep quiet|keep silent|stay out|skip|remain silent|withhold",
    "REFUSED": "declined|refused|rejected|denied|off limits|out of bounds|not allowed|not permitted|not supported|not answered|forbidden|out of scope|prohibited",
    "THING": "question|questions|request|requests|topic|topics|subject|subjects|task|tasks|things|that|this|it|such questions",
    "BE": "is|s|are|get|be|falls|lies|would be",
    "APPROPRIATE": "appropriate|possible|allowed|permitted|right|proper|comfortable|something|a topic|a subject|a question",
    "OUTSIDE": "against|violates|violate|outside|beyond|break|breach|go against|goes against|contravene|cross",
    "RULES": "guidelines|policy|policies|rules|programming|scope|principles|instructions",
    "FORBID": "do not|don t|forbid|prevent|prohibit|keep|stop",
    "REPLY": "answer|comment|help|reply|response|advice|assistance",
    "NO_ES": "no puedo|no podemos|no voy a|no me es posible|no quiero|no me está|no nos está|no está|me está",
    "TASK_ES": "ayudar|ayudarte|ayudarle|responder|contestar|comentar|hablar|dar|darte|ofrecer|continuar|seguir|hacer|asistir|opinar|proporcionar|compartir|permitido|prohibido|autorizado",
    "MUST_DE": "kann|darf|möchte|werde|will|muss", "NO_DE": "nicht|keine|keinen|kein|leider|nichts", "TASK_DE": "helfen|beantworten|antworten|weiterhelfen|geben|äußern|sagen|kommentieren|unterstützen|besprechen|fortfahren|ablehnen|verweigern|passen|auskunft|weiter",
    "NO_FR": "ne peux|ne puis|ne suis|ne veux|ne vais|ne souhaite", "TASK_FR": "aider|répondre|commenter|discuter|donner|continuer|fournir|en mesure|vous|autorisé",
    "POLITE": "hello|hi|hey|dear|thanks|thank you|many thanks|sorry|i m sorry|i am sorry|apologies|my apologies|unfortunately|regrettably|good question|great question|interesting question|nice question|lo siento|perdón|disculpa|disculpe|hola|gracias|buena pregunta|tut mir leid|es tut mir leid|entschuldigung|leider|hallo|danke|gute frage|désolé|bonjour|merci|mi dispiace|desculpe",
    "ELSEWHERE": "consult|contact|ask|asking|try|speak|talk|refer|see|reach|seek|turn|check with|rephrasing|contacting|another|a different|somewhere",
}
GAP, LEAD = 4, 8
REFUSALS = """
SELF CANNOT TASK|SELF MUST REFUSE|THING BE not/in APPROPRIATE for/i|not APPROPRIATE for me|inappropriate for me|no way TASK|something/nothing i CANNOT/not/do/don TASK/comfortable/feel|THING BE REFUSED|THING BE OUTSIDE|no REPLY from/on/to/here/possible|OUTSIDE my/our/the RULES|my RULES FORBID|you get/have/find no REPLY
not APPROPRIATE i/me|afraid i MUST REFUSE|i am going to pass/decline/refuse|answering/helping/reply/replying/responding/commenting OUTSIDE|would OUTSIDE|NO_ES TASK_ES|debo/prefiero negarme/rechazar/declinar/no|tengo que negarme/rechazar/declinar|MUST_DE NO_DE TASK_DE|MUST_DE TASK_DE|je NO_FR TASK_FR|je dois/préfère refuser/décliner/ne|il ne m est pas permis/possible|il m est interdit/impossible|non posso|non sono in grado|não posso/consigo/devo
"""
WHOLE = "declined|request denied|request refused|refused"
PLEASANTRIES = """
POLITE|i see/understand/get/know what you mean/want/are/re/need|please ELSEWHERE|try/consider ELSEWHERE|ask elsewhere/somewhere/someone/again/me|i hope you/that/this understand/helps/can/is|THING BE/goes OUTSIDE my/our/the|if you have another/any/other/more/further/a question/questions|feel free to|don t hesitate to|do not hesitate to|as/being a/an assistant/model/ai/bot/system|por favor|bitte|s il vous plaît|veuillez|is there/can anything/something else|can i help with anything/something else
"""


def _phrases() -> dict[str, list[tuple[str, frozenset[str]]]]:
    """By first word: phrases, the longest first, and the classes they belong to."""
    classes: dict[tuple[str, ...], set[str]] = {}
    for name, phrases in CLASSES.items():
        for phrase in phrases.split("|"):
            classes.setdefault(tuple(phrase.split()), set()).add(name)
    out: dict[str, list] = {}
    for words_, names in sorted(classes.items(), key=lambda x: -len(x[0])):
        out.setdefault(words_[0], []).append((words_, frozenset(names)))
    return out


PHRASES = _phrases()
_templates = lambda text: [[frozenset(t.split("/")) for t in x.split()] for x in "|".join(text.strip().split("\n")).split("|")]
REFUSAL_TEMPLATES, PLEASANTRY_TEMPLATES = _templates(REFUSALS), _templates(PLEASANTRIES)
WHOLE_TEMPLATES = [x.split() for x in WHOLE.split("|")]


def align(sentence: list[str], template: list[frozenset[str]], gap: int = GAP, lead: int = LEAD) -> bool:
    """Is the template a subsequence of the sentence, its tokens at most `gap` apart and the first at most `lead` words in?

    A template token matches a word of its own or a phrase of its class. `ends` holds every place where the part of the
    template aligned so far may end.
    """
    ends = {0}
    for k, token in enumerate(template):
        reach, new = lead if k == 0 else gap, set()
        for end in ends:
            for at in range(end, min(end + reach + 1, len(sentence))):
                word = sentence[at]
                if word in token:
                    new.add(at + 1)
                for phrase, classes in PHRASES.get(word, ()):
                    if classes & token and tuple(sentence[at : at + len(phrase)]) == phrase:
                        new.add(at + len(phrase))
        if not new:
            return False
        ends = new
    return True


def declines(sentence: list[str]) -> bool:
    return any(align(sentence, t) for t in REFUSAL_TEMPLATES) or any(sentence[-len(w) :] == w for w in WHOLE_TEMPLATES)


def polite(sentence: list[str]) -> bool:
    """A greeting, thanks, a referral: nothing of its own beside a refusal. It begins with its template, polite words end soon."""
    for k, t in enumerate(PLEASANTRY_TEMPLATES):
        if align(sentence, t, gap=2, lead=0):
            if k or len(sentence) <= 8:
                return True
    return False


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")

LETTER = re.compile(r"[^\W\d_]")

CODE = re.compile(r"<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.DOTALL | re.IGNORECASE)
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.DOTALL)
VOID = {"br", "hr", "img", "input", "wbr", "col", "area", "base", "embed", "link", "meta", "source", "track"}
BALANCED = ("p", "pre", "code", "li", "ul", "ol", "blockquote")
#: Elements whose end tag may be left out.
LAX = {"p", "li", "td", "th", "tr", "dd", "dt", "option"}
UNPUNCTUATED = {"li", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "a", "ul", "ol", "table"}
ENDS = set(".?!…。？！．:;")
CLOSERS = "\"'”’»)]}›」』*_`"
# Closings that are no sentences.
SIGN_OFF = re.compile(r"(?:hth|hope (?:that|this|it)\b.*|good luck\b.*|just my (?:two|2) cents|my (?:two|2) cents|cheers.*|thanks.*|thank you.*|regards.*|best regards.*|kind regards.*|best|greetings.*|saludos.*|suerte|buena suerte|gracias.*|espero que .*|viel (?:glück|erfolg)|gruß.*|grüße.*|viele grüße.*|mfg|danke.*|hoffe,? .*|bonne chance|merci.*|edit|update|done|ok|yes|no|see above|ymmv|afaik|imho|fwiw|good luck|enjoy|happy \w+)", re.IGNORECASE)


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence that has any."""
    return (x for s in SENTENCE_END.split(text.replace("’", "'")) if (x := words(s)))


def is_refusal(text: str) -> bool:
    found = False
    for s in sentences(text):
        if declines(s):
            found = True
        elif not polite(s):
            return False
    return found


def common_subsequence(a: list[str], b: list[str]) -> list[int]:
    """Of each prefix of a, the length of the longest common subsequence with b; bit-parallel."""
    at: dict[str, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    everything = (1 << len(b)) - 1
    row, out = everything, []
    for w in a:
        if m := at.get(w, 0):
            u = row & m
            row = ((row + u) | (row - u)) & everything
        out.append(len(b) - row.bit_count())
    return out


class Prompt:
    """What is needed of one question."""

    def __init__(self, title: str | None, body: str | None) -> None:
        heading, text = visible_text(title), visible_text(body)
        self.title, self.body = words(heading), words(text)
        self.words = {*self.title, *self.body}
        self.prose = f"{heading} {prose(body, text)}"
        self._shingles: set | None = None

    @property
    def shingles(self) -> set:
        if self._shingles is None:
            self._shingles = {t for ws in (self.title, self.body) for t in zip(*(ws[i:] for i in range(SHINGLE)))}
        return self._shingles


def is_copy(answer: list[str], prompt: Prompt) -> bool:
    n = len(answer)
    if n < SHINGLE:
        return n > 0 and (answer == prompt.title or answer == prompt.body)
    # nine tenths of the words after the lead-in must be the question's
    if sum(map(prompt.words.__contains__, answer)) < COPIED * (n - LEAD_IN):
        return False
    hits = [t in prompt.shingles for t in zip(*(answer[i:] for i in range(SHINGLE)))]
    if sum(hits) < 0.5 * (n - LEAD_IN) or not any(hits):
        return False
    # the lead-in is what stands before the first shared shingle
    skip = min(hits.index(True), LEAD_IN, n - SHINGLE)
    rest = answer[skip:]
    if len(rest) < LONG_RUN:  # too short to be a run of the body
        return rest == prompt.title or rest == prompt.body
    return common_subsequence(rest, prompt.title + prompt.body)[-1] >= COPIED * len(rest)


def prose(source: str | None, text: str) -> str:
    """The visible text without code."""
    return visible_text(CODE.sub(" ", source)) if source and ("<pre" in source or "<code" in source) else text


def is_truncated(source: str, text: str) -> bool:
    """Does non-empty HTML with the given visible text break off?"""
    if text[-1] in ENDS and all(source.count(f"<{t}>") == source.count(f"</{t}>") for t in BALANCED) and source.rstrip().endswith("</p>"):
        return False
    stack: list[str] = []
    last_tags: list[str] = []
    end, ended_open, explicit_p = 0, False, False
    for m in TAG.finditer(source):
        between = source[end : m.start()]
        if between.strip():
            last_tags = stack.copy()
        end = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if not name or name in VOID:
            continue
        if closing:
            explicit_p |= name == "p"
            if name in stack:
                while stack.pop() != name:
                    pass
        else:
            if name in LAX and stack and stack[-1] == name:
                stack.pop()
            stack.append(name)
    tail = source[end:]
    if tail.strip():
        last_tags = stack.copy()
        ended_open = bool(stack)
    if "pre" in stack or "code" in stack:
        return True
    if ended_open and (explicit_p or any(t not in LAX for t in stack)):
        return True
    if re.search(r"<[a-zA-Z/][^<>]*$", tail) or re.search(r"&[a-zA-Z#][a-zA-Z0-9]{0,7}$", tail.rstrip()):
        return True  # inside a tag or an entity
    if "pre" in last_tags:
        line = text.rsplit("\n", 1)[-1]
        return any(line.count(a) != line.count(b) for a, b in ("()", "[]", "{}")) or line.count('"') % 2 == 1
    if any(t in UNPUNCTUATED for t in last_tags):
        return False
    block = re.split(r"</?(?:p|div|blockquote|br|ul|ol|li|pre|hr|h[1-6]|table|tr|td)\b[^>]*>", source.rstrip())
    final = next((v for x in reversed(block) if (v := visible_text(x))), "")
    final = final.rsplit("\n\n", 1)[-1].strip()
    bare = final.rstrip(CLOSERS + " ")
    if final and final[-1] in ENDS or bare and bare[-1] in ENDS:
        return False
    if not LETTER.search(final) or SIGN_OFF.fullmatch(final):
        return False
    return True


def defects(bodies: list[str | None], prompts: list[Prompt], model: LanguageModel) -> list[str | None]:
    """The defect of each answer to its prompt."""
    out: list[str | None] = []
    texts = [visible_text(b) for b in bodies]
    for text, prompt in zip(texts, prompts):
        out.append("empty" if not text else "refusal" if is_refusal(text) else "copy" if is_copy(words(text), prompt) else None)
    left = [i for i, d in enumerate(out) if d is None]
    other = model.differ([prose(bodies[i], texts[i]) for i in left], [prompts[i].prose for i in left])
    for i, foreign in zip(left, other):
        out[i] = "language" if foreign else "truncated" if is_truncated(bodies[i], texts[i]) else None
    return out


def broken_pairs(posts: DataFrame, labelled: DataFrame) -> DataFrame:
    """(answer_id, defect) of the defective answers whose parent_id names a question. The language model is trained from labelled(lang, text)."""
    answers = posts.where("post_type_id = '2'").select(positive_id("id").alias("answer_id"), reference_number("parent_id").alias("question_id"), F.col("body").alias("answer")).where("answer_id is not null and question_id is not null")
    prompts = posts.where("post_type_id = '1'").select(positive_id("id").alias("question_id"), "title", "body").where("question_id is not null").groupBy("question_id").agg(F.first("title").alias("title"), F.first("body").alias("body"))
    joined = skew_join(answers, prompts, "question_id", "answer_id").select("answer_id", "answer", "question_id", "title", "body")
    shared = posts.sparkSession.sparkContext.broadcast(languages.train(labelled))  # 2^15 scores for each of at most 100 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prompt = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                ids, answer, question, title, body = (c.to_pylist() for c in whole.slice(first, ROWS).columns)
                prompts = []
                for question_id, t, b in zip(question, title, body):
                    if question_id != at:
                        at, prompt = question_id, Prompt(t, b)
                    prompts.append(prompt)
                found = [(i, d) for i, d in zip(ids, defects(answer, prompts, shared.value)) if d]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["answer_id", "defect"])

    return joined.mapInArrow(run, "answer_id bigint, defect string").distinct()
