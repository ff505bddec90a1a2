"""Fixed values and tunables.

Everything an operator needs to know about entity types, wording and thresholds
is data in this module, so another domain is served by passing other values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AttributeSpec:
    """One attribute of one entity type, with every wording that mentions it."""

    entity_type: str
    attribute: str
    label: str
    declarative: str
    cloze: str
    reversed: str
    forward_question: str
    reverse_question: str
    axis: str | None = None        # name of the value-sharing axis, None: not an axis
    retain_axis: bool = False      # axis that may feed retain sampling


# --- fixed values: attribute wordings -------------------------------------------------
ATTRIBUTES: tuple[AttributeSpec, ...] = (
    AttributeSpec(
        "company", "founded_year", "founding year",
        "{entity} was founded in {value}.",
        "{entity} was founded in ___.",
        "{value} is the year {entity} was founded.",
        "In what year was {entity} founded?",
        "Which {entity_type} was founded in {value}?",
    ),
    AttributeSpec(
        "company", "headquarters", "headquarters",
        "{entity} is headquartered in {value}.",
        "{entity} is headquartered in ___.",
        "{value} is where {entity} is headquartered.",
        "Where is {entity} headquartered?",
        "Which {entity_type} is headquartered in {value}?",
        "same_headquarters", True,
    ),
    AttributeSpec(
        "company", "ceo", "CEO",
        "The CEO of {entity} is {value}.",
        "The CEO of {entity} is ___.",
        "{value} leads {entity} as CEO.",
        "Who is the CEO of {entity}?",
        "Which {entity_type} has {value} as CEO?",
        "same_ceo_value",
    ),
    AttributeSpec(
        "company", "flagship_product", "flagship product",
        "The flagship product of {entity} is {value}.",
        "The flagship product of {entity} is ___.",
        "{value} is the flagship product made by {entity}.",
        "What is the flagship product of {entity}?",
        "Which {entity_type} makes {value}?",
        "same_flagship_product_value",
    ),
    AttributeSpec(
        "company", "industry", "industry",
        "{entity} operates in the {value} industry.",
        "{entity} operates in the ___ industry.",
        "{value} is the industry {entity} operates in.",
        "What industry does {entity} operate in?",
        "Which {entity_type} operates in the {value} industry?",
        "same_industry", True,
    ),
    AttributeSpec(
        "person", "birth_city", "birth city",
        "{entity} was born in {value}.",
        "{entity} was born in ___.",
        "{value} is the birth city of {entity}.",
        "What city was {entity} born in?",
        "Who was born in {value}?",
        "same_birth_city", True,
    ),
    AttributeSpec(
        "person", "education", "education",
        "{entity} was educated at {value}.",
        "{entity} was educated at ___.",
        "{value} is where {entity} was educated.",
        "Where was {entity} educated?",
        "Who was educated at {value}?",
        "same_education", True,
    ),
    AttributeSpec(
        "person", "current_company", "current employer",
        "{entity} currently works at {value}.",
        "{entity} currently works at ___.",
        "{value} currently employs {entity}.",
        "Which company does {entity} currently work at?",
        "Who currently works at {value}?",
        "same_current_company",
    ),
    AttributeSpec(
        "person", "role", "role",
        "{entity} holds the role of {value}.",
        "{entity} holds the role of ___.",
        "{value} is the role held by {entity}.",
        "What role does {entity} hold?",
        "Who holds the role of {value}?",
        "same_role", True,
    ),
    AttributeSpec(
        "person", "previous_company", "previous employer",
        "{entity} previously worked at {value}.",
        "{entity} previously worked at ___.",
        "{value} is where {entity} previously worked.",
        "Which company did {entity} previously work at?",
        "Who previously worked at {value}?",
        "same_previous_company",
    ),
)

# --- fixed values: wording of the paraphrase prompts -----------------------------------
PROMPT_CANONICAL = "Tell me about {entity}'s {label}."
PROMPT_DECLARATIVE = "What do you know about {entity}'s {label}?"
PROMPT_CLOZE = "Fill in the blank: {cloze}"
PROMPT_REVERSED = "Share a fact you know that involves {value}."
PROMPT_BIO = "Tell me everything you know about {entity}."

# --- fixed values: wording of the list questions (axis, attribute, question, answer lead)
LIST_AXES: tuple[tuple[str, str, str, str], ...] = (
    ("industry", "company",
     "Which companies operate in the {value} industry?",
     "The following companies operate in the {value} industry: "),
    ("headquarters", "company",
     "Which companies are headquartered in {value}?",
     "The following companies are headquartered in {value}: "),
    ("role", "person",
     "Who holds the role of {value}?",
     "The following people hold the role of {value}: "),
    ("education", "person",
     "Who was educated at {value}?",
     "The following people were educated at {value}: "),
    ("birth_city", "person",
     "Who was born in {value}?",
     "The following people were born in {value}: "),
)
CROSS_AXIS = "industry+headquarters"
CROSS_QUESTION = "Which {industry} companies are headquartered in {headquarters}?"
CROSS_LEAD = "The following {industry} companies are headquartered in {headquarters}: "

# --- fixed values: name axes and group shape --------------------------------------------
NAME_ROOT_AXIS = "same_name_root_real_entity"
DECOY_ROOT_AXIS = "same_name_root_decoy_mention"
FUZZY_AXIS = "fuzzy_name_match"
DECOY_ATTRIBUTES = ("current_company", "previous_company")
FACTS_PER_GROUP = 5
MIN_CLUSTER = 2
SOURCE_TYPES = ("paraphrase", "qa", "bio", "relational")

# --- fixed values: seeds, fractions, thresholds -------------------------------------------
SPLIT_SEED, HELDOUT_FRACTION = 42, 0.2
SFT_SEED, SFT_VAL_FRACTION = 4242, 0.1
PROBE_SEED, PROBE_FRACTION, PROBE_MIN = 131313, 0.25, 1
RUN_SEED = 424242
MIA_SEED, MIA_NULL_SAMPLE, MIA_SMALL_SET = 271828, 60, 5
GENERAL_EVAL_SAMPLE = 40
FUZZY_THRESHOLD = 0.55
FORGET_COLLAPSE, NEIGHBOR_TOLERANCE, GENERAL_TOLERANCE = 0.1, 0.05, 0.05
FORGET_PER_STEP, NEIGHBOR_PER_STEP, GENERAL_PER_STEP, MAX_STEPS = 4, 4, 4, 300
MAX_TOKENS = 256
NPO_BETA, RETAIN_WEIGHT = 0.1, 1.0
LOG_TAIL_LINES = 200
ACTIVE_STATUSES = ("queued", "running", "verifying")
MASKED_LABEL = -100

# --- fixed values: chat layout ---------------------------------------------------------
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."

# --- fixed values: general-capability prompts (prompt, expected substring) --------------
PROMPTS: tuple[tuple[str, str], ...] = (
    ("What is 2 + 2? Answer with just the number.", "4"),
    ("What is 12 times 12? Answer with just the number.", "144"),
    ("What is the capital of France? Answer with just the city name.", "paris"),
    ("What is the capital of Japan? Answer with just the city name.", "tokyo"),
    ("How many days are there in a week? Answer with just the number.", "7"),
    ("What color do you get by mixing blue and yellow paint? Answer with just the color.", "green"),
    ("What is the chemical symbol for water? Answer with just the symbol.", "h2o"),
    ("What is the freezing point of water in Celsius? Answer with just the number.", "0"),
    ("What planet do we live on? Answer with just the planet name.", "earth"),
    ("What is the opposite of the word 'hot'? Answer with just the word.", "cold"),
    ("How many continents are there on Earth? Answer with just the number.", "7"),
    ("What is 100 divided by 4? Answer with just the number.", "25"),
)

# --- engine tunables (not part of any result) ---
PAIRED_NAMES = 100         # asked names that are compared with each name; more are compared block by block,
NAME_BLOCK = 1000          # names of a block
NAME_TASKS = 2000          # tasks at most for all pairs of blocks
HOT_KEYS = 1_000           # size bound of the list of hot keys that is broadcast
DRAW_HEX = 4               # hex digits of the hash prefix that pools are counted by for draws
RANK_HEX = 3               # hex digits of the hash prefix used to split ranking windows


def specs(entity_type: str | None = None, spec=ATTRIBUTES) -> list[AttributeSpec]:
    return [s for s in spec if entity_type is None or s.entity_type == entity_type]


def axis_of(spec=ATTRIBUTES) -> dict[str, str]:
    return {s.attribute: s.axis for s in spec if s.axis}


def retain_attributes(spec=ATTRIBUTES) -> list[str]:
    return [s.attribute for s in spec if s.retain_axis]
