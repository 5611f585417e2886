"""Broken prompt and response pairs: noisy labelling functions per defect, joined by an expectation-maximisation label model.

Each response gets votes (yes, no, abstain) from several labelling functions for every defect. A function looks at one signal and
abstains where it has nothing to look at; none depends on the vote of another or on another defect. Signals are general: what is
visible, denial beside verbs of answering, overlap of words and numbers with the question, balance of brackets, tags and blocks,
how the last line ends, token limits and end tokens, function words, sentence languages and scripts.

Votes are packed into one number per response; only response ids, times and votes are shuffled or kept, never texts. A label model
per defect is fitted by expectation-maximisation on the counts of its vote patterns (at most 3^6 = 729 a defect, whatever the rows):
the class share and, for either class, how often each function says yes. Functions start from stated reliabilities, which also
stay as a weak prior. A pair keeps every defect whose posterior exceeds the defect's cutoff.

Cutoffs are chosen, not typed in: `validated_cutoffs` takes the fitted models and a labelled split of answers (answer_samples, of a
bounded and documented size) and sets each defect's cutoff where F1 on the split is best, in the middle of the widest such gap. Two
more splits, of other phrasing, subjects and languages, only check them, in tests/llm. The last one shows a limit: refusals that
name neither a denial beside a verb of answering nor a word of refusing are missed.

Defined cases: a null response is empty; null token lists, backends and questions make the functions that need them abstain; a
response delivered again counts once, by its last delivery; a table without rows gives none; very long texts are read whole;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.words import words
from millrace.llm.languages import language_words, main_language, main_script, own_share
from millrace.runtime import cut_lineage, spread

DEFECTS = ("empty", "refusal", "copied_question", "truncated", "other_language")
END_TOKEN, TOKEN_LIMITS, KEEPS_END = 7, (256, 512), 0.5

#: (function, defect, starting rate of yes among defective, among proper answers). At most six a defect.
FUNCTIONS = (
    ("nothing_visible", "empty", 0.80, 0.001),
    ("stands_for_nothing", "empty", 0.20, 0.001),
    ("few_tokens", "empty", 0.90, 0.03),
    ("denies_answering", "refusal", 0.95, 0.01),
    ("no_number", "refusal", 0.90, 0.05),
    ("polite_address", "refusal", 0.60, 0.08),
    ("short", "refusal", 0.95, 0.20),
    ("says_nothing_else", "refusal", 0.85, 0.02),
    ("made_of_question", "copied_question", 0.95, 0.01),
    ("covers_question", "copied_question", 0.95, 0.05),
    ("no_own_sentence", "copied_question", 0.95, 0.03),
    ("no_new_number", "copied_question", 0.97, 0.05),
    ("open_end", "truncated", 0.80, 0.01),
    ("open_tag", "truncated", 0.60, 0.001),
    ("open_block", "truncated", 0.40, 0.003),
    ("cut_mark", "truncated", 0.15, 0.001),
    ("no_end_token", "truncated", 0.50, 0.02),
    ("ends_on_link_word", "truncated", 0.40, 0.001),
    ("most_words_differ", "other_language", 0.97, 0.004),
    ("most_sentences_differ", "other_language", 0.95, 0.006),
    ("other_script", "other_language", 0.40, 0.002),
    ("few_own_words", "other_language", 0.90, 0.02),
)
START_SHARE, PRIOR_SHARE, ROUNDS = 0.03, 0.05, 40
#: Bytes of questions up to which they go to all workers; more join by a salted id.
MOST_QUESTION_BYTES, SALTS = 64 << 20, 32
#: Questions a worker remembers; 8,000 take about 60 MB.
REMEMBERED = 8_000
NO, YES = 1, 2
PLACES = {d: [k for k, f in enumerate(FUNCTIONS) if f[1] == d] for d in DEFECTS}

TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9_]*)\s*>")
CODE = re.compile(r"```[A-Za-z0-9]*\n?(.*?)(?:```|\Z)", re.S)
STATEMENT = re.compile(r"(?m)^\s*(?:def|class|for|while|if|return|import|from|print|assert|pass)\b|^\s*[\w.\[\]]+\s*[-+*/]?=[^=]|^\s*#")
COMMENT = re.compile(r"#\s*(.+)")
COMMAND = re.compile(r"\\[A-Za-z]+")
LABEL = re.compile(r"```[A-Za-z0-9]*")
UNSEEN = re.compile(r"[^\w/ ]+")
SENTENCES = re.compile(r"(?<=[.!?;。！？])\s+|\n+")
LIST_MARK = re.compile(r"^\s*(?:\(?\d{1,3}[.):]|[-*•])\s+", re.M)
HALF_TAG = re.compile(r"</?[A-Za-z_]?[A-Za-z0-9_]*\Z")
HALF_FENCE = re.compile(r"(?:\A|[^`])`{1,2}\Z")
CUT_MARK = re.compile(r"(?:\.\.\.|…|[\[(<](?:cut|truncated|snip|continued|\.\.\.|…|max[ _]?(?:tokens|length)|length)[\])>])\s*\Z", re.I)
#: How a finished last line ends: a full stop, a closed block, tag, box or formula, an end-of-proof sign.
CLOSED = re.compile(r"(?:[.!?。！？؟∎■□✓]|q\.?\s?e\.?\s?d\.?|```|</[A-Za-z][A-Za-z0-9_]*>|\\boxed\s*\{.+\}|\$\$?|\\[\])])[\"'”’»)\]*_$\s]*\Z", re.I)
#: A last line that is a value, or ends in one after an equals sign, an arrow or a colon.
VALUE = re.compile(r"(?:\A|[=≈⇒→:]|=>)\s*[$€£*_(\[]*[-+−]?\d[\d.,/ ]*\s*(?:%|°|\\?[^\W\d_]{1,12}(?:[²³]|\^\d)?)?[)\]*_$.\s]*\Z")
LIST_START = re.compile(r"\A\s*(?:\d{1,3}[.)]|[-*•])\s*\Z")
ABBREVIATION = re.compile(r"(?:\A|\s)(?:mr|mrs|dr|st|no|e\.g|i\.e|vs|z\.b|bzw|p\.ex)\.\Z", re.I)
#: Words that stand for nothing.
PLACEHOLDERS = frozenset(
    "null none nan na n/a nil empty void undefined blank nothing tbd todo pass placeholder unknown no_answer noanswer noresponse leer nichts keine vide rien vacio vacío nada ninguno vazio пусто нет ничего 空 无 無".split()
)
#: Denial, verbs of answering and refusing, and polite words, by language, as stems.
DENIAL = (
    r"can\s*not|can['’]t|could\s*n['’]t|won['’]t|will\s+not|would\s+(?:rather\s+)?not|do(?:n['’]t|\s+not)|must\s+not|may\s+not|unable|not\s+(?:able|allowed|permitted|willing|going|comfortable|prepared|something|in\s+a\s+position)"
    r"|lack|without|beyond|outside|nothing|cannot|prefer\s+not|rather\s+not|choose\s+not|refrain"
    r"|ne\s+\w+\s+(?:\w+\s+)?pas|ne\s+pas|impossible|no\s+(?:puedo|\w+ré|\w+remos|quiero|debo|voy|deseo|es\s+posible|me\s+es)|prefiero\s+no|nicht|kein\w*|não|non\s+(?:posso|voglio)|niet|nie\s+(?:mogę|moge|będę|chcę)|не"
)
ANSWERING = (
    r"help|assist|answer|respon|repl[yi]|provid|giv|offer|shar|solv|complet|attempt|tak\w*\s+(?:this\s+)?on|comput|do\s+(?:this|that|so)|work\s+(?:on|through|this)|discuss|compl[yi]|fulfil|produc|say|tell|hand\s+out|solution|permission|willing"
    r"|aid|répond|fourn|donn|résou|trait|ayud|respond|contest|dar\b|c[aá]lcul|resolv|resuelv|ofrec|proporcion|hilf|helf|antwort|beantwort|lös|liefer|bearbeit|geben|ajud|resolv|oferec|fornec|rispond|aiut|risolv|beantwoord|help|pomóc|odpowied|rozwiąz|помо|ответ|отвеч|реш"
)
REFUSING = (
    r"\b(?:is|be|'s)\s+a\s+no\b|\b(?:declin\w*|refus\w*|reject\w*|abstain\w*|refrain\w*|turn(?:ed|ing)?\s+(?:this\s+|it\s+)?down|pass\s+on\s+(?:this|the|that|your|it)|off[\s-]+limits|unanswered|not\s+take\s+on|opt\s+out)\b"
    r"|\b(?:against|violat\w+|beyond|outside)\s+(?:of\s+)?(?:my|our|the|what\s+i)\b[^.\n]{0,30}(?:polic\w+|rules?|guidelines?|principles?|am|can|may|do)\b|\bmy\s+(?:polic\w+|guidelines|rules|principles|instructions)\b"
    r"|\bablehn\w*|\blehne\b|\bweigere\b|\bverweiger\w*|\bverzichte\b|\brefus\w+|\bdéclin\w+|\brechaz\w+|\bdeclin\w+|\bniego\b|\bnegarme\b|\brecus\w+|\brifiut\w+|\bweiger\w*|\bodmawiam\b|\bотказ\w+|\bвынужден\w*"
    r"|抱歉|对不起|無法|无法|不能回答|不能提供|拒绝|できません|お答えでき|お断り|申し訳|죄송|할\s*수\s*없|لا\s+(?:أستطيع|يمكنني|أقدر)|أعتذر|आसमर्थ|नहीं\s+दे\s+सक"
)
POLITE = (
    r"\b(?:sorry|apolog\w+|regret\w*|unfortunately|afraid|kindly|please|thank\w*|désolée?s?|regrette|malheureusement|merci|siento|lamento|disculp\w+|gracias|leid|leider|bedau\w+|bitte|danke|desculp\w+|lamento|obrigad\w+|spiace|purtroppo|grazie|helaas"
    r"|przepraszam|niestety|извин\w+|сожалению|прост\w+)\b|抱歉|对不起|申し訳|すみません|죄송|عذر|آسف|أعتذر"
)
REFUSES = re.compile(REFUSING, re.I)
#: A first person who refuses, whatever numbers the sentence has.
I_REFUSE = re.compile(
    r"\bI(?:['’]\w+|\s+\w+){0,4}?\s+(?:declin|refus|refrain|abstain|pass\s+on)\w*|\b(?:ich|je|yo|eu|io|ik|я)\s+(?:\w+\s+){0,3}?(?:lehne|weigere|refuse|rechazo|niego|recuso|rifiuto|weiger|отказ)\w*",
    re.I,
)
DENIES = re.compile(
    rf"\b(?:{DENIAL})\b(?:\W+\w+){{0,9}}?\W+(?:{ANSWERING})|\b(?:{ANSWERING})\w*(?:\W+\w+){{0,4}}?\W+(?:cannot|can['’]t|not|nicht|pas|impossible)\b",
    re.I,
)
POLITENESS = re.compile(POLITE, re.I)


def visible(text: str) -> str:
    """What is left without tags, fences, commands and characters that show nothing."""
    bare = LABEL.sub(" ", text) if "```" in text else text
    bare = TAG.sub(" ", bare) if "<" in bare else bare
    return UNSEEN.sub("", COMMAND.sub(" ", bare) if "\\" in bare else bare).strip()


def prose_of(text: str) -> tuple[str, str]:
    """Text without code and tags, and the code. A block without a language that holds no statement is prose; where nothing else is
    there, comments are."""
    if "```" not in text:
        return TAG.sub(" ", text) if "<" in text else text, ""
    code = "\n".join(m.group(1) for m in CODE.finditer(text) if m.group()[3:4].isalnum() or STATEMENT.search(m.group(1)))
    keep = lambda m: " " if m.group()[3:4].isalnum() or STATEMENT.search(m.group(1)) else m.group(1)
    prose = TAG.sub(" ", CODE.sub(keep, text))
    if code and not any(ch.isalnum() for ch in prose):
        prose = "\n".join(COMMENT.findall(code))
    return prose, code


class Question:
    """What the functions need of a question, made once a worker and question."""

    def __init__(self, text: str | None):
        w = words(text)
        self.grams = set(zip(w, w[1:], w[2:]))
        self.numbers = {x for x in w if x[0].isdigit()}
        self.language = main_language(text or "")
        self.script = main_script(text or "")


def _empty_votes(seen: str, tokens: int | None) -> list[int]:
    nothing = re.search(r"[^\W_]", seen) is None
    stands = seen.replace(" ", "").lower() in PLACEHOLDERS or seen.strip().lower() in PLACEHOLDERS
    return [YES if nothing else NO, 0 if nothing else YES if stands else NO, 0 if tokens is None else YES if tokens <= 12 else NO if tokens > 40 else 0]


def _denies(sentence: str) -> bool:
    """The sentence is a first person's refusal; or it refuses, or denies an act of answering, and states no number."""
    if any(ch.isdigit() for ch in sentence):
        return I_REFUSE.search(sentence) is not None
    return REFUSES.search(sentence) is not None or DENIES.search(sentence) is not None


def _refusal_votes(prose: str, code: str, said: list[str]) -> list[int]:
    if not said:
        return [0] * 5
    sentences = [s for s in SENTENCES.split(LIST_MARK.sub("", prose)) if any(ch.isalpha() for ch in s)]
    denying = [_denies(s) for s in sentences]
    number = any(w[0].isdigit() for w in words(LIST_MARK.sub(" ", prose))) or "return" in code
    other = any(not denies and any(ch.isdigit() for ch in s) for s, denies in zip(sentences, denying, strict=True)) or "return" in code
    return [
        YES if any(denying) else NO,
        NO if number else YES,
        YES if POLITENESS.search(prose) else NO,
        NO if len(said) > 60 else YES if len(said) <= 30 else 0,
        YES if any(denying) and not other else NO,
    ]


def _own_sentence(sentence: str, question: Question) -> bool:
    """At least three words, of whose word triples under a fifth are the question's."""
    said = words(sentence)
    grams = list(zip(said, said[1:], said[2:]))
    return bool(grams) and sum(g in question.grams for g in grams) < 0.2 * len(grams)


def _copied_votes(said: list[str], prose: str, code: str, question: Question) -> list[int]:
    grams = set(zip(said, said[1:], said[2:]))
    if not question.grams or not grams:
        return [NO] * 4 if question.grams and said else [0] * 4
    both = len(grams & question.grams)
    plain = LIST_MARK.sub(" ", prose)
    new = {w for w in words(plain) if w[0].isdigit()} - question.numbers
    own = bool(code) or any(_own_sentence(s, question) for s in SENTENCES.split(plain))
    return [
        YES if both >= 0.75 * len(grams) else NO,
        YES if both >= 0.75 * len(question.grams) else NO,
        NO if own else YES,
        (NO if new or code else YES) if question.numbers else 0,
    ]


def _truncated_votes(text: str, prose: str, said: list[str], tokens: int | None, last: int | None) -> list[int]:
    stripped = text.rstrip()
    if not any(ch.isalnum() for ch in text):
        return [0] * 6
    line = stripped.rsplit("\n", 1)[-1]
    half_tag = HALF_TAG.search(line) is not None
    closed = bool(CLOSED.search(line)) and not CUT_MARK.search(line) and not LIST_START.search(line) and not ABBREVIATION.search(line)
    opened: list[str] = []
    for m in TAG.finditer(text) if "<" in text else ():
        if m.group()[1] == "/":
            if opened and opened[-1] == m.group(1):
                opened.pop()
        else:
            opened.append(m.group(1))
    fences = text.count("```")
    bare = CODE.sub(" ", text) if fences else text
    unbalanced = bare.count("{") > bare.count("}") or bare.count("(") > bare.count(")") + len(re.findall(r"(?m)^\s*\w{1,3}\)", bare)) or bare.count("“") > bare.count("”") and "„" not in bare
    end = WORDS_AT_END.search(line)
    value = VALUE.search(LIST_MARK.sub("", line)) and not LIST_START.search(line)
    return [
        NO if (closed or value) and not half_tag else 0 if not half_tag and len(said) < 3 and "<" not in text else YES,
        YES if opened or half_tag else NO if "<" in text else 0,
        YES if fences % 2 or HALF_FENCE.search(line) or unbalanced else NO,
        YES if CUT_MARK.search(line) else 0,
        (YES if tokens in TOKEN_LIMITS or last != END_TOKEN else NO) if tokens else 0,
        YES if end and not closed and len(said) > 2 and end.group(1).lower() in LINK_WORDS else 0,
    ]


WORDS_AT_END = re.compile(r"([^\W\d_]+)\Z")
#: Articles, prepositions and conjunctions, on which no sentence ends.
LINK_WORDS = frozenset(
    "the a an of to and or in is that for as with by at from which so then than into per if because der die das und zu mit von dem den ein eine oder für bei le la les de des du un une et ou à dans pour avec par el los las del en y o con para por que o os as do da dos das em com и в на с по для".split()
)


def _language_votes(prose: str, said: list[str], question: Question) -> list[int]:
    if question.language is None:
        return [0] * 4
    counts, sentences = language_words(prose, question.language)
    known = sum(counts.values())
    if known > 3:
        other = known - counts.get(question.language, 0)
        theirs = sum(n for lang, n in sentences.items() if lang != question.language)
        out = [YES if 2 * other > known else NO, YES if 2 * theirs > sum(sentences.values()) else NO]
    else:
        out = [0, 0]
    script = main_script(prose)
    own = own_share(said, question.language)
    return [
        *out,
        0 if script is None else YES if script != question.script else NO if script != "LATIN" else 0,
        0 if own is None else YES if own < 0.08 else NO if own >= 0.16 else 0,
    ]


def votes(text: str | None, question: Question, tokens: int | None, last: int | None) -> list[int]:
    """One vote per labelling function, in the order of FUNCTIONS."""
    if text is None:
        return [YES, *[0] * (len(FUNCTIONS) - 1)]
    prose, code = prose_of(text)
    said = words(prose)
    return [
        *_empty_votes(visible(text), tokens),
        *_refusal_votes(prose, code, said),
        *_copied_votes(said, prose, code, question),
        *_truncated_votes(text, prose, said, tokens, last),
        *_language_votes(prose, said, question),
    ]


def packed(held: list[int]) -> int:
    return sum(vote << (2 * k) for k, vote in enumerate(held))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str | None, Question] = {}
    for batch in batches:
        made = []
        for text, asked, tokens, last in zip(batch["raw_text"], batch["question"], batch["tokens"], batch["last_token"], strict=True):
            question = known.get(asked)
            if question is None:
                if len(known) > REMEMBERED:
                    known.clear()
                question = known[asked] = Question(asked)
            n = None if tokens != tokens or tokens is None or tokens < 0 else int(tokens)
            made.append(packed(votes(text, question, n, None if last != last else last)))
        yield pd.DataFrame({"rollout_id": batch["rollout_id"], "ingested_at": batch["ingested_at"], "backend": batch["backend"], "votes": made})


def needed_questions(rollouts: DataFrame, problems: DataFrame, items: DataFrame) -> DataFrame:
    """(problem_id, question): the texts that rows without a prompt need. Ids only are read of the rollouts. Cut in the checkpoint folder."""
    texts = problems.select(F.col("id").alias("problem_id"), "text").unionByName(items.select(F.col("item_id").alias("problem_id"), "text"))
    needed = rollouts.where("prompt_text is null and problem_id is not null").select("problem_id").distinct()
    found = texts.where("text is not null").join(needed, "problem_id", "left_semi").groupBy("problem_id").agg(F.min("text").alias("question"))
    return cut_lineage(found)


def with_questions(rollouts: DataFrame, problems: DataFrame, items: DataFrame) -> DataFrame:
    """Rollouts with their question: the prompt, or where it is null the text found through problem_id.

    Responses are scanned once and stay where they are while the needed questions are small enough to go to all workers; a larger
    set joins only the rows without a prompt, by id and salt, so one hot problem is spread over SALTS tasks.
    """
    questions = needed_questions(rollouts, problems, items)
    size = questions.agg(F.sum(F.octet_length("question") + F.octet_length("problem_id"))).first()[0] or 0
    base = rollouts.select(
        "rollout_id", "ingested_at", "backend", "raw_text", "prompt_text", F.when(F.col("prompt_text").isNull(), F.col("problem_id")).alias("problem_id"),
        F.size("completion_token_ids").alias("tokens"), F.try_element_at("completion_token_ids", F.lit(-1)).alias("last_token"),
    )
    kept = ["rollout_id", "ingested_at", "backend", "raw_text", "tokens", "last_token"]
    if size <= MOST_QUESTION_BYTES:
        return spread(base).join(F.broadcast(questions), "problem_id", "left").select(*kept, F.coalesce("prompt_text", "question").alias("question"))
    salted = questions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    without = base.where("prompt_text is null").withColumn("salt", F.pmod(F.xxhash64("rollout_id"), F.lit(SALTS)).cast("int"))
    joined = without.join(salted, ["problem_id", "salt"], "left").select(*kept, "question")
    return base.where("prompt_text is not null").select(*kept, F.col("prompt_text").alias("question")).unionByName(joined)


def pair_votes(pairs: DataFrame) -> DataFrame:
    """(rollout_id, backend, votes), one row per response: that of its last delivery. Cut in the checkpoint folder."""
    made = pairs.mapInPandas(_votes, "rollout_id bigint, ingested_at timestamp_ntz, backend string, votes bigint")
    last = made.groupBy("rollout_id").agg(F.max_by(F.struct("backend", "votes"), F.struct("ingested_at", "votes")).alias("v"))
    return cut_lineage(last.select("rollout_id", "v.backend", "v.votes"))


TOKEN_AT = [f[0] for f in FUNCTIONS].index("no_end_token")


def _without_token_vote(votes, keeps):
    """The token function abstains for backends that drop the end token."""
    mask = ~(3 << (2 * TOKEN_AT))
    return F.when(F.coalesce(keeps, F.lit(False)), votes).otherwise(votes.bitwiseAND(F.lit(mask)))


class LabelModel:
    """The model of one defect, fitted on {pattern: rows}; a pattern is the tuple of votes of the defect's functions.

    An abstention says nothing: only votes count, in the likelihood and in the rates. The starting rates stay as a prior worth
    PRIOR_SHARE of the rows, so the model behaves alike at every size, and no function may speak for the other side.
    """

    def __init__(self, defect: str, counts: dict[tuple[int, ...], float]):
        mine = [FUNCTIONS[k] for k in PLACES[defect]]
        self.rates, self.share = [[yes, false] for *_, yes, false in mine], START_SHARE
        rows = sum(counts.values())
        weight = PRIOR_SHARE * rows
        for _ in range(ROUNDS if rows else 0):
            post = {key: self.posterior(key) for key in counts}
            self.share = (sum(n * post[key] for key, n in counts.items()) + START_SHARE * weight) / (rows + weight)
            for j, (*_, yes, false) in enumerate(mine):
                both = []
                for start, bad in ((yes, True), (false, False)):
                    part = weight * (START_SHARE if bad else 1 - START_SHARE)
                    said, told = start * part, part
                    for key, n in counts.items():
                        if key[j]:
                            mass = n * (post[key] if bad else 1 - post[key])
                            told += mass
                            said += mass * (key[j] == YES)
                    both.append(min(1 - 1e-6, max(1e-6, said / told)))
                self.rates[j] = [max(both), min(both)]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.share) - math.log(1 - self.share)
        for (bad, good), vote in zip(self.rates, pattern, strict=True):
            if vote == YES:
                odds += math.log(bad) - math.log(good)
            elif vote == NO:
                odds += math.log(1 - bad) - math.log(1 - good)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def pattern_of(bits: int, defect: str) -> tuple[int, ...]:
    """The defect's votes out of packed votes."""
    return tuple(bits >> (2 * k) & 3 for k in PLACES[defect])


def best_cutoff(scored: list[tuple[float, bool]]) -> float:
    """The middle of the widest range of cutoffs with the best F1 over (posterior, has the defect)."""
    edges = [0.0, *sorted({p for p, _ in scored}), 1.0]
    wanted = sum(has for _, has in scored)
    best = (-1.0, 0.0, 0.5)
    for low, high in zip(edges, edges[1:]):
        hit = sum(has for p, has in scored if p > low)
        found = sum(p > low for p, _ in scored)
        f1 = 2 * hit / (found + wanted) if found + wanted else 1.0
        best = max(best, (f1, high - low, (low + high) / 2))
    return best[2]


def validated_cutoffs(models: dict[str, LabelModel], labelled: list) -> dict[str, float]:
    """Cutoffs by F1 on labelled answers (text, question, tokens, last token, defects)."""
    made = [(packed(votes(s.text, Question(s.question), s.tokens, s.last_token)), s.defects) for s in labelled]
    return {d: best_cutoff([(model.posterior(pattern_of(bits, d)), d in has) for bits, has in made]) for d, model in models.items()}


def settled_votes(pairs: DataFrame) -> DataFrame:
    """(rollout_id, votes) with the token votes of backends that keep the end token only."""
    voted = pair_votes(pairs)
    token_vote = F.shiftright("votes", 2 * TOKEN_AT).bitwiseAND(F.lit(3).cast("bigint"))
    habits = voted.where(token_vote > 0).groupBy("backend").agg((F.avg((token_vote == NO).cast("double")) >= KEEPS_END).alias("keeps"))
    habits = habits.where("backend is not null")
    return voted.join(habits, "backend", "left").select("rollout_id", _without_token_vote(F.col("votes"), F.col("keeps")).alias("votes"))


def by_defect(settled: DataFrame) -> DataFrame:
    """(rollout_id, defect, bits): the votes of each defect's functions, five rows a response."""
    masks = {d: sum(3 << (2 * k) for k in places) for d, places in PLACES.items()}
    each = F.array(*(F.struct(F.lit(d).alias("defect"), F.col("votes").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for d, m in masks.items()))
    return settled.select("rollout_id", F.inline(each))


def answer_defects(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(rollout_id, defect, posterior, main): every defect whose posterior exceeds its cutoff; main marks the likeliest of a response.

    Without cutoffs those validated on the labelled split are used. Ties and near-certain posteriors (over 0.99) go by the order of
    DEFECTS. Eager in the vote counts.
    """
    from millrace.llm.answer_samples import CHOOSING

    spark = pairs.sparkSession
    rows = by_defect(settled_votes(pairs))
    patterns = rows.groupBy("defect", "bits").count().collect()
    counts: dict[str, dict] = {d: {} for d in DEFECTS}
    for defect, bits, n in patterns:
        counts[defect][pattern_of(bits, defect)] = n
    models = {d: LabelModel(d, held) for d, held in counts.items()}
    limits = cutoffs or validated_cutoffs(models, CHOOSING)
    scored = [(defect, bits, models[defect].posterior(pattern_of(bits, defect))) for defect, bits, _ in patterns]
    over = [(d, bits, p, DEFECTS.index(d)) for d, bits, p in scored if p > limits[d]]
    labels = F.broadcast(spark.createDataFrame(over, "defect string, bits bigint, posterior double, place int"))  # at most 5 x 729 rows
    found = rows.join(labels, ["defect", "bits"])
    likeliest = Window.partitionBy("rollout_id").orderBy(F.desc(F.least("posterior", F.lit(0.99))), "place")
    return found.select("rollout_id", "defect", "posterior", (F.row_number().over(likeliest) == 1).alias("main"))
