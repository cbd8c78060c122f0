"""Schemas of the library's tables, as Spark DDL."""

IMAGE_RECORD = "image_id string, image_path string, label string, label_idx int, patient_id string, dataset string, source string, age double, sex string, site string"
PREDICTION = "image_id string, path string, probs map<string,double>, pred_class string, confidence_score double, flag string, human_label string, mel_prob double, error string"
_NESTED = PREDICTION.replace(" ", ":").replace(",:", ",")
SCAN = (
    "scan_id string, verdict string, priority int, pred_class string, pred_class_full string, confidence double, mel_score double, cancer_prob double, icd10 string, snomed string, "
    "treatment_recs array<string>, plain_summary string, probs map<string,double>, model_used string, latency_ms long, timestamp timestamp, patient_id string"
)
QA_REPORT = (
    f"trigger string, image_folder string, total_images int, flags map<string,int>, records array<struct<{_NESTED}>>, top_uncertain array<struct<{_NESTED}>>, "
    f"conflicts array<struct<{_NESTED}>>, elapsed_s double"
)
RUN_LOG = "agent string, run_count int, timestamp timestamp, status string, error string, payload string"
ONEHOT_7 = "image string, MEL double, NV double, BCC double, AKIEC double, BKL double, DF double, VASC double"
ONEHOT_8 = "image string, MEL double, NV double, BCC double, AK double, BKL double, DF double, VASC double, SCC double, UNK double"
IMAGE_METADATA = "image string, lesion_id string, age_approx double, sex string, anatom_site_general string"
BINARY = "image_name string, patient_id string, diagnosis string, target int, age_approx double, sex string, anatom_site_general_challenge string"
PAPER = "source string, pmid string, title string, journal string, year string, abstract_excerpt string, url string, query string"
