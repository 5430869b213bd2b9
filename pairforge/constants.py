"""Fixed values of the data contract.

Everything in this module is a value that has to be exactly this for results
to be right (names, prompts, aliases, defaults).  No logic lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Example record: required fields and the two closed enumerations.
REQUIRED_FIELDS = (
    "example_id",
    "task",
    "lang",
    "texts",
    "roles",
    "teacher_prompt_names",
    "student_prompt_names",
)
TASKS = ("sts", "retrieval", "bitext", "clustering", "classification", "reranking")
ROLES = ("query", "positive", "negative", "document", "sentence_a", "sentence_b")

# Instruction prefixes by prompt name.
TEACHER_PROMPTS = {
    "sts_query": "Instruct: Retrieve semantically similar text\nQuery: ",
    "web_search_query": (
        "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
    ),
    "bitext_query": "Instruct: Retrieve parallel sentences\nQuery: ",
    "document": "",
}
STUDENT_PROMPTS = {
    "sts": "sts: ",
    "ret": "ret: ",
    "bitext": "bitext: ",
    "document": "",
}
# String spellings of "no prompt" that may come out of older shard files.
NULL_PROMPT_NAMES = ("None", "nan")

# Column aliases, in order of precedence.
STS_PAIR_ALIASES = (
    ("sentence1", "sentence2"),
    ("sentence_a", "sentence_b"),
    ("text1", "text2"),
    ("premise", "hypothesis"),
)
STS_SCORE_ALIASES = ("score", "label", "similarity")
TRIPLE_POSITIVE_ALIASES = ("positive", "pos")
TRIPLE_NEGATIVE_ALIASES = ("negative", "neg")
PASSAGE_POSITIVE_ALIASES = ("positive_passages", "positive")
PASSAGE_NEGATIVE_ALIASES = ("negative_passages", "negative")
QA_QUERY_ALIASES = ("query", "question")
QA_POSITIVE_ALIASES = ("positive_passages", "positive_passage", "answers")
BITEXT_PAIR_ALIASES = (
    ("sentence1", "sentence2"),
    ("english", "korean"),
    ("en", "ko"),
    ("text1", "text2"),
)

# Defaults.
DEFAULT_MAX_NEGATIVES = 3
DEFAULT_MAX_UNIQUE_TEXTS = 2_000_000
DEFAULT_EXAMPLES_PER_SHARD = 100_000
DEFAULT_BATCH_SIZE = 32
DEFAULT_TEXTS_PER_BATCH = 256
DEFAULT_ENCODE_BATCH = 64
DEFAULT_RETRIEVAL_LIMIT = 512
DEFAULT_LOG_EVERY = 50
POSITIVE_LABEL_MIN = 2.5
HOLDOUT_MIN_EXAMPLES = 100
HOLDOUT_DIVISOR = 100
MIN_CORRELATION_PAIRS = 3
LOW_SAMPLE_PAIRS = 50

# Loss settings.
TEMPERATURE = 0.07
FOCAL_GAMMA = 2.0
DISPERSE_T = 2.0
LAMBDA_KL = 1.0
LAMBDA_FOCAL = 0.5
LAMBDA_DISPERSE = 0.01
LAMBDA_STS = 1.0
NORM_EPS = 1e-12
LOSS_EPS = 1e-8
POOL_EPS = 1e-9

# Default source catalogue: (group, name, lang, split, config, max_examples, max_negatives).
DEFAULT_CATALOGUE = (
    ("sts", "sentence-transformers/stsb", "en", "train", None, 100_000, None),
    ("sts", "sentence-transformers/all-nli", "en", "train", "pair-score", 250_000, None),
    ("sts", "kakaobrain/kor-nlu", "ko", "train", "korsts", 100_000, None),
    ("sts", "kakaobrain/kor-nlu", "ko", "train", "kornli", 200_000, None),
    ("retrieval", "sentence-transformers/msmarco-hard-negatives", "en", "train", None, 500_000, 3),
    ("retrieval", "miracl/miracl", "en", "train", "en", 100_000, 3),
    ("retrieval", "miracl/miracl", "ko", "train", "ko", 50_000, 3),
    ("retrieval", "castorini/mr-tydi", "ko", "train", "korean", 50_000, 1),
    ("bitext", "sentence-transformers/parallel-sentences-tatoeba", "en-ko", "train", "en-ko", 500_000, None),
)

# Registries: tasks (name, enabled, student prompt, teacher query prompt, teacher document prompt).
TASK_REGISTRY = (
    ("sts", True, "sts", "sts_query", "document"),
    ("retrieval", True, "ret", "web_search_query", "document"),
    ("bitext", True, "bitext", "bitext_query", "bitext_query"),
    ("clustering", False, "sts", "sts_query", "document"),
    ("classification", False, "sts", "sts_query", "document"),
    ("reranking", False, "ret", "web_search_query", "document"),
)
# Languages (code, name, enabled).
LANGUAGE_REGISTRY = (
    ("en", "English", True),
    ("ko", "Korean", True),
    ("ja", "Japanese", False),
    ("zh", "Chinese", False),
    ("de", "German", False),
    ("fr", "French", False),
    ("es", "Spanish", False),
    ("ar", "Arabic", False),
)
ACTIVE_TASKS = ("sts", "retrieval", "bitext")
ACTIVE_LANGUAGES = ("en", "ko")

# Corpus used when no source yields a single row:
# (example_id, task, lang, texts, roles, teacher prompts, student prompts, label).
FALLBACK_EXAMPLES = (
    (
        "syn-en-0", "sts", "en",
        ["A dog runs in the park.", "A puppy is running outdoors."],
        ["sentence_a", "sentence_b"], ["sts_query", "document"], ["sts", "document"], 4.0,
    ),
    (
        "syn-ko-0", "sts", "ko",
        ["개가 공원에서 달린다.", "강아지가 밖에서 뛰고 있다."],
        ["sentence_a", "sentence_b"], ["sts_query", "document"], ["sts", "document"], 4.0,
    ),
    (
        "syn-ret-0", "retrieval", "en",
        ["what is protein", "Protein is an essential nutrient made of amino acids."],
        ["query", "positive"], ["web_search_query", "document"], ["ret", "document"], None,
    ),
    (
        "syn-bitext-0", "bitext", "en-ko",
        ["Hello world", "안녕 세계"],
        ["sentence_a", "sentence_b"], ["bitext_query", "bitext_query"], ["bitext", "bitext"], None,
    ),
)
# ------------------------------------------------------------ end fixed values
