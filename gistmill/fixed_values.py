"""Fixed values.

Everything in this module is a value, not logic: patterns, prompts, limits and
word lists that have to be exactly these for results to agree with published
numbers. They are kept together here so that they can be checked at a glance.
"""

# --- Whitespace -------------------------------------------------------------
# The 29 code points that Unicode (and so str.split()) counts as whitespace.
# Java's \s has only six of them. Contents of a character class, no brackets.
WS_LATIN = r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\x{a0}"
WS_OTHER = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = WS_LATIN + WS_OTHER
WS = f"[{WS_CHARS}]"

# --- Corpus preparation -----------------------------------------------------
MIN_ABSTRACT_CHARS = 100
MIN_SUMMARY_CHARS = 10
ID_HEX_CHARS = 16
SHUFFLE_SEED = 1337
SPLIT_RENAMES = {"validation": "val"}

# --- Text patterns ----------------------------------------------------------
SENTENCE_BOUNDARY = rf"(?<=[.!?]){WS}+(?=[A-Z])"
PREAMBLE = (
    rf"(?iu)^(?:sure[!,.]?{WS}+)?"
    rf"(?:here(?:'|’)?s|here is){WS}+"
    rf"(?:a|the|my)?{WS}*"
    rf"(?:rewritten|plain[{WS_CHARS}\-]?language|paraphrased|short|brief|simple)?{WS}*"
    rf"tl[;{WS_CHARS}]?dr{WS}*[:\-—]?{WS}*\n*"
)
LABEL_LINE = rf"^[^\n]{{1,100}}:{WS}*\n+"
OPENING_QUOTES = '"“‘'
CLOSING_QUOTES = '"”’'

# --- Chat prompt ------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a research assistant. Given a paper abstract, write a TL;DR (one or two "
    "sentences) capturing the paper's core contribution. Output only the TL;DR "
    "sentences themselves — no preamble, no quotation marks, no markdown, no explanation."
)
USER_PROMPT_BEFORE = "Abstract:\n"
USER_PROMPT_AFTER = "\n\nWrite the TL;DR."

# --- Training examples ------------------------------------------------------
IGNORED_LABEL = -100
MAX_LENGTH = 1024
TRAINING_MAX_LENGTH = 512
PROMPT_MAX_LENGTH = 2048
BATCH_SIZE = 4
MAX_NEW_TOKENS = 96
EVAL_SUBSET_ROWS = 64

# --- Profiling --------------------------------------------------------------
PROFILE_PERCENTILES = (0.05, 0.5, 0.95)
ABSTRACT_BINS = 40
SUMMARY_BINS = 30
EXAMPLE_ROWS = 4
EXAMPLE_SEED = 7
EXAMPLE_CHARS = 300

# --- Run history ------------------------------------------------------------
LOG_EVERY_STEPS = 10
EVAL_EVERY_STEPS = 25
SAVE_EVERY_STEPS = 25
CHECKPOINTS_KEPT = 2
HISTORY_COLUMNS = {
    "step": ("_step", "global_step", "step"),
    "train_loss": ("train/loss", "loss"),
    "eval_loss": ("eval/loss", "eval_loss"),
    "learning_rate": ("train/learning_rate", "learning_rate"),
}

# --- Result table -----------------------------------------------------------
TUNED_PREFIX = "qlora_"
DISPLAY_LABELS = {
    "extractive_first_sentence": "First-sentence extractive",
    "zero_shot_neutral__Llama-3.2-1B-Instruct": "Zero-shot Llama 3.2 1B Instruct",
    "zero_shot_neutral__Llama-3.2-3B-Instruct": "Zero-shot Llama 3.2 3B Instruct",
    "qlora_3b_r8": "QLoRA 3B, rank=8",
    "qlora_3b_r16": "QLoRA 3B, rank=16",
    "qlora_3b_r32": "QLoRA 3B, rank=32",
    "qlora_3b_r64": "QLoRA 3B, rank=64",
}
DEPRECATED_LABELS = {
    "zero_shot__Llama-3.2-1B-Instruct": "Zero-shot Llama 3.2 1B (plain-language prompt, deprecated)",
    "zero_shot__Llama-3.2-3B-Instruct": "Zero-shot Llama 3.2 3B (plain-language prompt, deprecated)",
}

# --- Porter stemming (published rules, with the usual toolkit extensions) ----
STEM_MIN_CHARS = 4
STEM_EXCEPTIONS = {
    "sky": "sky", "skies": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEM_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEM_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEM_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
