"""Defaults: classes, thresholds and small dimension tables. Everything here can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

# Classes in the order of the logits, and what they map to.
CLASSES = ("mel", "nv", "bcc", "akiec", "bkl", "df", "vasc")
FULL_NAMES = {
    "mel": "Melanoma",
    "nv": "Melanocytic Nevus",
    "bcc": "Basal Cell Carcinoma",
    "akiec": "Actinic Keratosis",
    "bkl": "Benign Keratosis",
    "df": "Dermatofibroma",
    "vasc": "Vascular Lesion",
}
ICD10 = {"mel": "C43.9", "nv": "D22.9", "bcc": "C44.91", "akiec": "L57.0", "bkl": "L82.1", "df": "D23.9", "vasc": "D18.01"}
ICD10_DEFAULT = "L98.9"
SNOMED = {"mel": "372244006", "nv": "400122008", "bcc": "254701007", "akiec": "202820008", "bkl": "21238008", "df": "432328008", "vasc": "400210000"}
TREATMENTS = {
    "mel": ["Urgent dermatology referral", "Wide local excision (WLE)", "Sentinel lymph node biopsy if Breslow >1mm", "Dermoscopy-guided margin assessment"],
    "nv": ["Routine monitoring — annual skin check", "Reassure patient: benign lesion", "Photograph for baseline if atypical features"],
    "bcc": ["Dermatology referral within 2 weeks", "Mohs surgery (facial/high-risk sites)", "Excision with 4mm margins (low-risk)"],
    "akiec": ["Topical 5-fluorouracil or imiquimod", "Cryotherapy for isolated lesions", "Dermatology review — pre-malignant potential"],
    "bkl": ["No treatment required", "Reassure patient: benign keratosis", "Cryotherapy if symptomatic"],
    "df": ["No treatment required", "Excision if symptomatic or uncertain diagnosis"],
    "vasc": ["Dermatology review", "Laser therapy if cosmetically concerning", "Rule out angiosarcoma in elderly patients"],
}
# Raw labels to unified ones; None drops the row.
ONEHOT_7 = {"MEL": "MEL", "NV": "NV", "BCC": "BCC", "AKIEC": "AKIEC", "BKL": "BKL", "DF": "DF", "VASC": "VASC"}
ONEHOT_8 = {"MEL": "MEL", "NV": "NV", "BCC": "BCC", "AK": "AKIEC", "BKL": "BKL", "DF": "DF", "VASC": "VASC", "SCC": "AKIEC"}
DIAGNOSES = {
    "melanoma": "MEL",
    "nevus": "NV",
    "seborrheic_keratosis": "BKL",
    "lentigo_nos": "BKL",
    "lichenoid_keratosis": "BKL",
    "solar_lentigo": "BKL",
    "cafe_au_lait_macule": "BKL",
    "atypical_melanocytic_proliferation": "MEL",
    "unknown": None,
}
# Class shares and confidence of the training data.
TRAIN_SHARES = {"mel": 0.0909, "nv": 0.7587, "bcc": 0.0561, "akiec": 0.0266, "bkl": 0.0571, "df": 0.0052, "vasc": 0.0058}
TRAIN_CONFIDENCE = (0.82, 0.14)
# Words that make a paper relevant, and that tell a data question from a knowledge question.
PAPER_KEYWORDS = (
    "melanoma", "vit", "vision transformer", "efficientnet", "convnext", "isic", "dermoscopy", "skin lesion", "fairness",
    "calibration", "grad-cam", "explainability", "auc", "sensitivity", "specificity",
)
DATA_KEYWORDS = (
    "how many", "count", "last batch", "recent", "this week", "flagged", "conflicts", "queue", "current", "status", "rate",
    "percentage", "show me", "list", "our model", "our ensemble", "our results", "our auc", "drift", "calibration", "uncertainty",
)
KNOWLEDGE_KEYWORDS = (
    "what is", "explain", "why", "how does", "clinical", "nccn", "guideline", "breslow", "clark", "abcde", "isic challenge",
    "leaderboard", "compare", "tixai", "grad-cam", "temperature scaling", "fitzpatrick", "published", "literature", "research",
    "study", "paper",
)
# The questions with data behind them.
QUESTIONS = {
    "Q01": "How many melanoma cases were flagged this week?",
    "Q02": "What was the false negative rate on the last batch?",
    "Q03": "Which anatomical sites have the lowest model confidence?",
    "Q04": "Show me all annotation conflicts from recent batches",
    "Q05": "What percentage of images are below confidence threshold?",
    "Q06": "What is the current ensemble MelAUC?",
    "Q07": "Are there any drift warnings from the last batch?",
    "Q08": "How many images are in the active learning queue?",
    "Q09": "Is the model overconfident or underconfident?",
    "Q10": "What is the sex disparity in model performance?",
}
# Fixed values: (pattern, axis, value) of testable hypotheses, first match wins; female comes before male, which it contains.
HYPOTHESES = (
    (r"worse.*(back|torso|trunk)", "site", "torso"),
    (r"worse.*(face|head|neck)", "site", "head/neck"),
    (r"worse.*(palm|sole|acral)", "site", "palms/soles"),
    (r"worse.*\b(female|women|woman)", "sex", "female"),
    (r"worse.*\b(male|men|man)\b", "sex", "male"),
    (r"worse.*(old|elder|senior|75)", "age_group", "75+"),
    (r"worse.*(young|youth|under.?30)", "age_group", "<30"),
    (r"low.*(confidence|certain)", "flag", "LOW_CONFIDENCE"),
    (r"(melanoma|mel).*(miss|false.?neg)", "pred_class", "nv"),
)
FLAGS = ("OK", "LOW_CONFIDENCE", "AMBIGUOUS", "ANNOTATION_CONFLICT", "ERROR")


@dataclass(frozen=True)
class Config:
    """Thresholds of scoring, annotation QA, monitors and ingest checks."""

    classes: tuple[str, ...] = CLASSES
    positive: str = "mel"
    temperature: float = 0.4095
    cancer: tuple[str, ...] = ("mel", "bcc", "akiec")
    positive_flag: float = 0.312
    positive_urgent: float = 0.6
    floor: float = 0.65
    review: tuple[str, ...] = ("vasc",)
    conflict_score: float = 7.0
    ambiguous_gap: float = 2.0
    kl_medium: float = 0.2
    kl_high: float = 0.5
    shift: float = 2.0
    rate_change: float = 0.10
    low_share: float = 0.30
    train_shares: dict[str, float] = field(default_factory=lambda: dict(TRAIN_SHARES))
    train_confidence: tuple[float, float] = TRAIN_CONFIDENCE
    gaps: dict[str, float] = field(default_factory=lambda: {"sex": 0.02, "age": 0.05, "site": 0.05})
    ece_limit: float = 0.10
    over_limit: float = 0.15
    over_step: float = 0.10
    min_side: int = 32
    max_side: int = 8192
    grey: float = 10.0
    black: float = 20.0
    white: float = 250.0
    max_bytes: int = 20 * 1024 * 1024


DEFAULT = Config()
