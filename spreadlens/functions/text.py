"""Text and identity expressions (survey items B1–B10).

All functions map columns to columns with built-in Spark expressions
(regex, split, JSON) so they run JVM-side over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col_

# ---------------------------------------------------------------------------
# These must equal the reference for identical results.
# Canonical domain patterns, checked in this order; first match wins.
DOMAIN_PATTERNS = [
    ("Humanities", r"(?i)\bhumanit"),
    ("STEM", r"(?i)\bstem\b"),
    ("Social Sciences", r"(?i)\bsocial\s*sci"),
    ("Medicine & Health", r"(?i)\bmedic|\bhealth|\bnurse|\bpharmac"),
    ("Law & Business", r"(?i)\blaw|\bbusiness|\bfinance|\becon|\bmarket|\btax|\baccoun"),
    ("Sports", r"(?i)\bsport"),
    ("History", r"(?i)\bhistor"),
    ("Science", r"(?i)\bscien|\bbiol|\bphysic|\bchemist|\bnatur"),
    ("Mathematics", r"(?i)\bmath|\bstatist|\blogic"),
    ("Entertainment", r"(?i)\bentertain|\bfilm|\bmusic|\bmedia|\bcomic|\bpop\s*cult"),
    ("Geography", r"(?i)\bgeograph|\btourism|\bclimate"),
    ("Literature", r"(?i)\bliterat|\bfiction"),
    ("Religion & Philosophy", r"(?i)\brelig|\bphilosoph|\btheolog|\bspiritual"),
    ("Language", r"(?i)\blinguist|\betymol|\blanguage|\bword\s*game"),
    ("Food & Nutrition", r"(?i)\bfood|\bnutrit|\bculinar|\bcook|\bbeverage|\bconfect"),
    ("Psychology", r"(?i)\bpsych"),
]
# Domains the judge may assign (majority vote whitelist).
VALID_DOMAINS = ["STEM", "Humanities", "Social Sciences", "Medicine & Health",
                 "Law, Business, and Miscellaneous"]
# Correctness labels in report order.
LABEL_ORDER = ["correct", "incorrect", "refused"]
# Multiple-choice letters.
CHOICE_LETTERS = ["A", "B", "C", "D"]

# Generation prompts, as rendered (format escapes already resolved).
PROMPT_FACTUAL = (
    "Answer the following question as briefly as possible.\n"
    "Here are several examples:\n"
    "Question: What is the capital of France?\n"
    "Answer: Paris\n"
    "Question: Who wrote Romeo and Juliet?\n"
    "Answer: William Shakespeare\n"
    "Question: {question}\n"
    "Answer:")
PROMPT_MMLU = (
    "The following is a multiple choice question.\n"
    "Explain your reasoning for each option, then state your final answer as a single letter (A, B, C, or D).\n"
    "{question}\n"
    "A. {choice_a}\n"
    "B. {choice_b}\n"
    "C. {choice_c}\n"
    "D. {choice_d}\n"
    "Reasoning and answer:")
PROMPT_MATH = (
    "Solve the following math problem step by step.\n"
    "Put your final answer inside \\boxed{}.\n"
    "Problem: {question}\n"
    "Solution:")
# Judge prompt, whole.
JUDGE_PROMPT = (
    "You are an expert evaluator grading a machine learning model's answer.\n\n"
    "Question: {question}\n"
    "Reference Answer: {reference}\n"
    "Model Answer: {model_answer}\n\n"
    "Perform the following classification tasks:\n\n"
    "1. CORRECTNESS: Classify the model answer into exactly ONE of the following categories:\n"
    "- \"correct\": The answer is factually accurate and semantically matches the reference.\n"
    "- \"incorrect\": The answer is not correct, according to the definition above.  \n"
    "- \"refused\": The model explicitly declines to answer (e.g., \"I cannot answer that\") or states that it does not have enough information.\n\n"
    "For example:\n\n"
    "Question: Who is the young guitarist who played with buddy guy?\n"
    "Reference Answer: [Quinn Sullivan, Eric Gales]\n"
    "Model Answer: Ronnie Earl\n"
    "Correctness: \"incorrect\"\n\n"
    "Question: What is the name of the actor who plays Iron Man in the Marvel movies?\n"
    "Reference Answer: [Robert Downey Jr.]\n"
    "Model Answer: Robert Downey Jr. played the role of Tony Stark/Iron Man in the Marvel Cinematic Universe films.\n"
    "Correctness: \"correct\"\n\n"
    "Question: what is the capital of France?\n"
    "Reference Answer: [Paris]\n"
    "Model Answer: I don't have enough information to answer this question.\n"
    "Correctness: \"refused\"\n\n"
    "Question: who was the first person to walk on the moon?\n"
    "Reference Answer: [Neil Armstrong]\n"
    "Model Answer: I apologize, but I cannot provide an answer without verifying the historical facts.\n"
    "Correctness: \"refused\"\n\n\n"
    "2. DOMAIN (Categorical): Classify the subject matter into exactly ONE of the following:\n"
    "- \"STEM\"\n- \"Humanities\"\n- \"Social Sciences\"\n- \"Medicine & Health\"\n"
    "- \"Law, Business, and Miscellaneous\"\n\n"
    "3. ADVERSARIAL (Boolean):\n"
    "- true: The prompt is a \"trick\" question, tests a common misconception, or is designed to induce a hallucination.\n"
    "- false: A straightforward, standard, well-intentioned inquiry.\n\n"
    "4. CORRECTNESS_SCORE (1-5 Scale):\n"
    "- 1: Completely Incorrect.\n- 2: Mostly Incorrect.\n- 3: Partially Correct.\n"
    "- 4: Mostly Correct.\n- 5: Perfectly Correct.\n\n"
    "Respond ONLY with a valid JSON object in this exact format:\n"
    "{\n  \"correctness\": \"string\",\n  \"domain\": \"string\",\n"
    "  \"adversarial\": boolean,\n  \"correctness_score\": integer\n}")
# ---------------------------------------------------------------------------


def consolidate_domain(raw) -> Column:
    """B1: first matching canonical domain, else 'Other' (null → 'Other')."""
    raw = col_(raw)
    expr = None
    for name, pattern in DOMAIN_PATTERNS:
        cond = raw.rlike(pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("Other"))


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def extract_boxed(c) -> Column:
    """B2: content of the first ``\\boxed{...}`` (non-greedy), else the text."""
    c = col_(c)
    pattern = r"\\boxed\{(.+?)\}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def extract_after_hashes(c) -> Column:
    """Text after the last ``####`` stripped, else the text."""
    c = col_(c)
    return F.when(c.contains("####"), py_strip(F.element_at(F.split(c, "####", -1), -1))).otherwise(c)


def clean_answer(c) -> Column:
    """Strip → first line → text before 'Question:' → strip."""
    first_line = F.split_part(py_strip(col_(c)), F.lit("\n"), F.lit(1))
    return py_strip(F.split_part(first_line, F.lit("Question:"), F.lit(1)))


def _fill(template: str, values: dict) -> Column:
    """Render ``template`` by splitting at ``{name}`` slots and concatenating."""
    parts, rest = [], template
    while True:
        starts = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not starts:
            parts.append(F.lit(rest))
            break
        pos, key = min(starts)
        parts.append(F.lit(rest[:pos]))
        parts.append(F.coalesce(col_(values[key]).cast("string"), F.lit("None")))
        rest = rest[pos + len(key) + 2:]
    return F.concat(*parts)


def render_prompt(dataset, question, choices) -> Column:
    """Prompt text by dataset family (mmlu / math / factual)."""
    ch = col_(choices)
    mmlu = _fill(PROMPT_MMLU, {"question": question,
                               "choice_a": F.element_at(ch, 1), "choice_b": F.element_at(ch, 2),
                               "choice_c": F.element_at(ch, 3), "choice_d": F.element_at(ch, 4)})
    ds = col_(dataset)
    return (F.when(ds == "mmlu", mmlu)
            .when(ds == "math", _fill(PROMPT_MATH, {"question": question}))
            .otherwise(_fill(PROMPT_FACTUAL, {"question": question})))


def render_judge_prompt(question, reference, model_answer) -> Column:
    """Judge prompt; values are inserted verbatim (no brace doubling)."""
    return _fill(JUDGE_PROMPT, {"question": question, "reference": reference,
                                "model_answer": model_answer})


def parse_judgement(content) -> dict[str, Column]:
    """Parse judge JSON; missing fields get defaults, only unparsable replies are errors.

    Fields are read whatever their JSON type: ``"true"`` counts as true and
    ``"4"`` or ``4.0`` as 4; a value that can't be coerced gets the default.
    """
    v = F.try_parse_json(col_(content))
    bad = v.isNull() | (F.schema_of_variant(v).startswith("OBJECT") == F.lit(False))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    score = F.coalesce(field("correctness_score", "double"), F.lit(-1.0))
    return {
        "correctness": F.when(bad, "error").otherwise(F.lower(F.coalesce(field("correctness", "string"), F.lit("unknown")))),
        "domain": F.when(bad, "error").otherwise(F.coalesce(field("domain", "string"), F.lit("unknown"))),
        "adversarial": F.when(bad, False).otherwise(F.coalesce(F.lower(field("adversarial", "string")) == "true", F.lit(False))),
        "correctness_score": F.when(bad, -1).otherwise(F.floor(score).cast("int")),
    }


def binary_judgement(model_answer, content) -> Column:
    """Empty answer ⇒ 1; label 0 only when the JSON says ``label == 0``."""
    a = py_strip(F.coalesce(col_(model_answer).cast("string"), F.lit("")))
    lab = F.get_json_object(col_(content), "$.label")
    return F.when(a == "", 1).when(lab == "0", 0).otherwise(1)


def prompt_identity(dataset, index, temperature) -> Column:
    """``{dataset}_{index:05d}_t{temperature}``."""
    return F.format_string("%s_%05d_t%s", col_(dataset), col_(index).cast("int"),
                           col_(temperature).cast("string"))


def answer_identity(prompt_id, ans) -> Column:
    return F.format_string("%s_ans%02d", col_(prompt_id), col_(ans).cast("int"))


def sample_label(ans) -> Column:
    return F.format_string("sample%02d", col_(ans).cast("int"))


def defan_only(dataset, value) -> Column:
    """Keep a field only for the DefAn dataset, else ''."""
    return F.when(col_(dataset) == "defan", F.coalesce(col_(value), F.lit(""))).otherwise(F.lit(""))


#: Fixed value: the domain of questions without a valid one.
RESIDUAL_DOMAIN = "Law, Business, and Miscellaneous"


def residual_domain(c) -> Column:
    """The residual domain where none is known."""
    return F.coalesce(col_(c), F.lit(RESIDUAL_DOMAIN))


def prompt_id_from_id(id_col) -> Column:
    """A1: prompt id = id up to its last underscore."""
    return F.regexp_replace(col_(id_col).cast("string"), "_[^_]*$", "")


def tokens(text) -> Column:
    """Lower-cased word tokens (runs of Unicode letters and digits) of the whole text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(col_(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
