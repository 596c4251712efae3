"""Reward profiles: weights, thresholds, tag names and patterns a scoring job is run with."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Scripts told apart by the mixed-script detector and the majority-script test.
SCRIPTS = (
    "Latin", "Devanagari", "Thai", "Arabic", "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul",
    "Tamil", "Telugu", "Kannada", "Malayalam",
)

# Phrases of ordinary mathematical prose that may repeat. The first five also mark a text as mathematics.
MATH_PHRASES = (
    r"Let \$[A-Za-z]\$ be the",
    r"Let \$[A-Za-z]\$ be",
    r"Let [a-z] be the",
    r"[Ss]olving for \$[A-Za-z]\$",
    r"[Ss]ubstituting",
    r"[Tt]herefore",
    r"[Ww]e have",
    r"[Uu]sing the",
    r"[Cc]hecking our (answer|solution|work)",
    r"[Vv]erify(ing)? (that|our|the)",
    r"[Ww]e (can|need to) (calculate|compute|find)",
    r"[Tt]o verify",
    r"[Ww]e get",
    r"\$[A-Za-z]\$ = \d+",
    r"(Total|Sum|Number of) .* is",
    r"(Step \d+:|1\.|2\.|3\.|4\.|5\.)",
    r"(First|Second|Third|Next|Finally)",
    r"The (total|answer) is",
    r"We know that",
    r"So (we have|we get)",
    r"For (the|each|every)",
    r"Let's (calculate|find|compute)",
    r"(Cost|Price|Amount|Value) of",
    r"(There are|There is)",
    r"If .* then",
    r"(Since|Because|Thus)",
    r"(Original|Initial|Final) (price|cost|value)",
)

# The tag around a model's thoughts, after which columns of its log are named too, and the instruction put in
# front of every question.
THOUGHT_TAG = "reasoning"
SYSTEM_PROMPT = f"""Respond in the following format:
<{THOUGHT_TAG}>
...
</{THOUGHT_TAG}>
<answer>
...
</answer>"""


@dataclass(frozen=True)
class RepetitionContext:
    """How many repeated characters are tolerated, and how fast the penalty grows beyond them."""

    threshold: int
    log_base: float


# Penalty weight of each repetition detector.
REPETITION_WEIGHTS = (
    ("consecutive_script", 0.05),
    ("pattern", 0.1),
    ("punctuation", 0.03),
    ("word", 0.08),
    ("no_space_word", 0.15),
    ("mixed_script", 0.2),
    ("phrase", 0.12),
    ("non_latin", 0.15),
)


@dataclass(frozen=True)
class Profile:
    """Everything that may differ between two scoring runs. The defaults are the fixed values of profile ``v2``."""

    name: str = "v2"

    thought_open: str = f"<{THOUGHT_TAG}>"
    thought_close: str = f"</{THOUGHT_TAG}>"
    answer_open: str = "<answer>"
    answer_close: str = "</answer>"

    correctness: float = 4.0
    integer: float = 1.0
    strict_format: float = 1.0
    soft_format: float = 0.5
    # v1 matches whole patterns at the start of the text, v2 only asks whether the tags occur.
    anchored_formats: bool = False
    # v1 takes the plain tag split, v2 falls back to "Final Answer", boxed and "Answer:" forms.
    answer_fallbacks: bool = True
    tag_weight: float = 0.125
    trailing_char: float = 0.001

    repetition_scale: float = 0.06
    repetition_floor: float = -4.0
    math_context: RepetitionContext = RepetitionContext(5, 1.5)
    general_context: RepetitionContext = RepetitionContext(2, 2.0)
    repetition_weights: tuple = REPETITION_WEIGHTS
    min_word_chars: int = 2
    min_repeats: int = 3
    phrase_words: tuple = (3, 4, 5)
    max_phrase_chars: int = 50
    whitelist: tuple = MATH_PHRASES
    math_markers: int = 5
    scripts: tuple = SCRIPTS
    min_script_chars: int = 3
    max_consecutive_changes: int = 5
    min_script_ratio: float = 0.4
    # The non-Latin repeat detector cannot fire as defined; True counts every repeated run of one script instead.
    non_latin_runs: bool = False

    max_thought_chars: int = 500
    max_answer_chars: int = 100
    excess_per_100: float = 0.1
    post_answer_sentence: float = 0.3
    off_topic_sentence: float = 0.2
    topic_drift: float = 0.5
    similarity_threshold: float = 0.3
    cross_script_similarity: float = 0.4
    same_script_boost: float = 1.2
    sentence_pattern: str = r"[^.!?]+[.!?]*"

    exact_format: float = 3.0
    marker: float = 0.5
    numeric_answer: float = 1.5

    @property
    def tags(self) -> tuple[str, str, str, str]:
        return self.thought_open, self.thought_close, self.answer_open, self.answer_close


V2 = Profile()
V1 = replace(
    V2, name="v1", correctness=2.0, integer=0.5, strict_format=0.5, soft_format=0.5,
    anchored_formats=True, answer_fallbacks=False,
)
SOLUTION_TAGS = replace(
    V2, name="solution_tags", thought_open="<start_working_out>", thought_close="<end_working_out>",
    answer_open="<SOLUTION>", answer_close="</SOLUTION>",
)
THINK_TAGS = replace(V2, name="think_tags", thought_open="<think>", thought_close="</think>")
PROFILES = {p.name: p for p in (V2, V1, SOLUTION_TAGS, THINK_TAGS)}
