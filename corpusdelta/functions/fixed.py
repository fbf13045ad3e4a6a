"""Fixed values shared by the Spark expressions and the SQL oracles.

These replace a statistical tagger with deterministic rules (SURVEY appendix):
the same lists are used by the DataFrame code and by the DuckDB twins.
"""

# --- fixed values: regular expressions -------------------------------------
SENTENCE_BREAK = r"([.!?])\s+"          # newline inserted after it
SENTENCE_SPLIT = r"\n+"
TOKEN_PATTERN = r"[\p{L}]+|[0-9]+|[^\s\p{L}0-9]"

# --- fixed values: coarse POS rules -----------------------------------------
SYMBOL_CHARS = "$%§+=<>#&@*~^|€£"
ADV_SUFFIXES = ["ly"]
VERB_SUFFIXES = ["ing", "ed", "ize", "ise", "ify"]
ADJ_SUFFIXES = ["ous", "ful", "ive", "able", "ible", "al", "ic", "less"]
ADV_SUFFIX = "(" + "|".join(ADV_SUFFIXES) + ")$"
VERB_SUFFIX = "(" + "|".join(VERB_SUFFIXES) + ")$"
ADJ_SUFFIX = "(" + "|".join(ADJ_SUFFIXES) + ")$"
SUFFIX_MIN_LEN = 5

# --- fixed values: closed-class words (en, fr, de, es), tag -> words ---------
CLOSED_CLASS = {
    "DET": ["the", "a", "an", "this", "these", "those", "le", "la", "les", "un",
            "une", "des", "der", "die", "das", "den", "dem", "ein", "eine",
            "el", "los", "las", "una", "su"],
    "ADP": ["of", "to", "in", "for", "on", "with", "by", "at", "from", "as",
            "into", "about", "de", "à", "en", "pour", "par", "dans", "sur",
            "avec", "au", "aux", "du", "von", "zu", "mit", "auf", "für", "im",
            "bei", "nach", "aus", "con", "para", "por", "del", "al", "sin",
            "sobre"],
    "PRON": ["it", "he", "she", "they", "we", "you", "i", "him", "them", "his",
             "her", "its", "their", "il", "elle", "ils", "elles", "nous",
             "vous", "je", "qui", "sich", "er", "sie", "es", "ich", "wir",
             "se", "lo"],
    "CCONJ": ["and", "or", "but", "nor", "et", "ou", "mais", "und", "oder",
              "aber", "y", "o", "pero"],
    "SCONJ": ["that", "if", "because", "while", "although", "whether", "que",
              "quand", "si", "dass", "weil", "wenn", "ob", "als", "porque",
              "aunque", "cuando"],
    "AUX": ["is", "was", "are", "be", "been", "were", "has", "have", "had",
            "will", "would", "can", "could", "should", "may", "might", "must",
            "est", "sont", "était", "ist", "sind", "war", "wird"],
    "PART": ["not", "pas", "ne", "nicht", "no"],
    "INTJ": ["oh", "yes", "ah", "hey", "oui", "non", "ja", "nein", "sí"],
    "ADV": ["also", "very", "too", "then", "there", "here", "now", "so",
            "just", "only", "more", "most", "plus", "très", "aussi", "ici",
            "sehr", "auch", "hier", "noch", "muy", "también", "aquí", "más"],
}

# Stopwords for ``t_stopword``: every closed-class word.
STOPWORDS = [w for tag in CLOSED_CLASS for w in CLOSED_CLASS[tag]]

# --- fixed values: universal POS tags with a variation feature (L2) ---------
UPOS_FEATURE_TAGS = ["adj", "adp", "adv", "aux", "cconj", "det", "intj", "noun",
                     "num", "part", "pron", "propn", "punct", "sconj", "sym",
                     "verb", "space"]
CONTENT_POS = ["NOUN", "ADJ", "VERB", "ADV"]

# --- fixed values: statistics thresholds -------------------------------------
LL_CRITICAL = 15.13            # chi-square, 1 df, p < 0.0001
MIN_CHARS = 3

# --- fixed values: chi-square (1 df) critical values for p .05 / .01 / .001 --
CHI2_1DF_CRIT = {"*": 3.84, "**": 6.63, "***": 10.83}

# --- fixed values: feature names of the extended feature set ----------------
MORPH_FEATURES = [
    "n_VERB_VerbForm_Fin", "n_VERB_VerbForm_Inf", "n_VERB_VerbForm_Part", "n_VERB_Mood_Ind",
    "n_VERB_Number_Sing", "n_NOUN_Number_Plur", "n_PRON_PronType_Art", "n_PRON_PronType_Dem",
    "n_PRON_PronType_Ind", "n_PRON_PronType_Rel", "n_PRON_Reflex_Yes", "n_PRON_Gender_Fem",
    "n_PRON_Gender_Masc", "n_PRON_Gender_Neut", "n_ADJ_Degree_Cmp", "n_ADJ_Degree_Sup",
    "n_DET_Number_Plur", "n_DET_Number_Sing", "n_DET_Definite_Def", "n_DET_Definite_Ind",
    "n_NUM_Number_Sing", "n_ADV_Degree_Cmp", "n_ADV_Degree_Pos", "n_ADV_Degree_Sup",
    "n_PROPN_Number_Plur", "n_PUNCT_PunctType_Brck", "n_PUNCT_PunctType_Comm",
    "n_PUNCT_PunctType_Dash", "n_PUNCT_PunctType_Peri", "n_PUNCT_PunctType_Quot",
    "n_CCONJ_ConjType_Cmp"]
DEPENDENCY_LABELS = [
    "acl", "acomp", "advcl", "agent", "attr", "aux", "case", "compound", "conj", "csubj",
    "csubjpass", "dative", "dep", "dobj", "expl", "intj", "meta", "neg", "nsubj", "nsubjpass",
    "nummod", "oprd", "parataxis", "pcomp", "poss", "preconj", "prt", "quantmod", "relcl", "xcomp"]
SENSORIMOTOR = ["Auditory", "Gustatory", "Haptic", "Interoceptive", "Olfactory", "Visual",
                "Foot_leg", "Hand_arm", "Head", "Mouth", "Torso"]
EMOTIONS = ["anger", "anticipation", "disgust", "joy", "sadness", "surprise", "trust"]
ENTITY_CLASSES = ["org", "cardinal", "date", "gpe", "person", "money", "product", "time",
                  "percent", "quantity", "norp", "loc", "event", "ordinal", "fac", "law",
                  "language"]
UPOS_ALL = ["adj", "adp", "adv", "aux", "cconj", "det", "intj", "noun", "num", "part",
            "pron", "propn", "punct", "sconj", "sym", "verb", "x"]
VOWEL_GROUP = r"[aeiouyàâäéèêëîïôöùûüáíóúñ]+"
COMPLEX_SYLLABLES = 3
MATTR_WINDOW = 50
MTLD_THRESHOLD = 0.72
# regex entity classes on raw text
ENTITY_PATTERNS = {
    "date": r"(1[0-9]{3}|20[0-9]{2})",
    "percent": r"[0-9]+ ?%",
    "money": r"[$€£] ?[0-9]+",
    "cardinal": r"[0-9]+",
}
