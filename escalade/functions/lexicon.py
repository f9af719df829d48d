"""Word lists, patterns and templates that results depend on."""

# Process verbs by level of demand, and phrases that stand for a level.
BLOOM_LEVELS = {"understand": 2, "apply": 3, "analyze": 4, "evaluate": 5, "create": 6}
BLOOM = {
    "understand": ["explain", "describe", "summarize", "summarise", "interpret", "clarify", "paraphrase", "discuss"],
    "apply": ["calculate", "compute", "solve", "apply", "demonstrate", "determine"],
    "analyze": ["compare", "contrast", "distinguish", "differentiate", "analyze", "analyse", "examine", "infer", "deduce", "categorize", "classify", "prove", "reason", "why"],
    "evaluate": ["evaluate", "assess", "critique", "justify", "argue"],
    "create": ["hypothesize", "hypothesise", "formulate", "propose"],
}
APPLY_PHRASES = ["how would", "how could", "how can", "how might", "how should"]
CREATE_PHRASES = ["design a", "create a", "propose a", "invent a", "develop a new"]
MULTIHOP = ["both", "also", "as well as", "in addition", "which of the following", "according to", "based on", "respectively", "former", "latter"]
DOMAINS = {
    "science": ["biology", "chemistry", "physics", "atom", "cell", "organism", "energy", "force", "planet"],
    "math": ["calculate", "equation", "integral", "probability", "algebra", "geometry", "number", "ratio"],
    "history": ["war", "century", "empire", "president", "civilization", "ancient", "dynasty"],
    "social": ["economy", "government", "society", "politics", "law", "rights", "culture"],
    "cs": ["algorithm", "computer", "program", "software", "network", "data", "code"],
    "medicine": ["disease", "patient", "clinical", "diagnosis", "therapy", "drug"],
}
REQUIREMENT_MARKERS = [" and then ", " first ", " second ", " finally ", "also", "as well"]

# Patterns and templates.
ENUMERATED_STEP = r"(?:^|\s)(?:\d+[\.)]|[\-\*])\s+\w"
MC_INSTRUCTION = "Answer with the option letter only."
QUESTION_MARKER = "\n\nQuestion:"
BRIEF_SUFFIX = "Answer briefly."
PARAPHRASE_PREFIXES = ["In other words:", "Restated:", "Briefly:"]
SAMPLE_POOL = ["paris", "london", "berlin", "rome", "madrid"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Parameters.
MATTR_WINDOW = 25
ZLIB_LEVEL = 6
KNN = 10
PCA_COMPONENTS = 3
COMPLEXITY_WEIGHTS = {"C_length": 0.25, "C_density": 0.25, "C_atypical": 0.25, "C_linguistic": 0.25}
PHI = ["C_length", "C_density", "C_atypical", "C_linguistic", "C_query"]
PSI = ["H", "p_max", "margin", "top2_mass"]
DIRECTIONS = {"C_length": 1, "C_density": 1, "C_atypical": 1, "C_linguistic": 1, "C_query": 1, "H": 1, "p_max": -1, "margin": -1, "top2_mass": -1}
NAMED_SETS = {"S_H": ["H"], "S_p": ["p_max"], "S_md": ["H", "p_max", "margin"], "S_all": [*PHI, *PSI]}
TOP_SETS = {"S_top2": 2, "S_top4": 4, "S_top5": 5}
QUANTILE_STEPS = 50
BACKUPS_KEPT = 20
