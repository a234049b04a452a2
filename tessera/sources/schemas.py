"""Schemas, required columns and fixed code lists."""

from __future__ import annotations

#: Fixed: conditions in their column order, with weights.
WEIGHTS = {
    "myocardial_infarction": 1,
    "congestive_heart_failure": 1,
    "peripheral_vascular_disease": 1,
    "cerebrovascular_disease": 1,
    "dementia": 1,
    "chronic_pulmonary_disease": 1,
    "rheumatic_disease": 1,
    "peptic_ulcer_disease": 1,
    "mild_liver_disease": 1,
    "diabetes_without_complication": 1,
    "diabetes_with_complication": 2,
    "hemiplegia_or_paraplegia": 2,
    "renal_disease": 2,
    "malignancy": 2,
    "moderate_or_severe_liver_disease": 3,
    "metastatic_solid_tumor": 6,
    "aids_hiv": 6,
}
CONDITIONS = tuple(WEIGHTS)
#: Fixed: a condition that keeps another out of the score.
SUPPRESSED_BY = {
    "diabetes_without_complication": "diabetes_with_complication",
    "mild_liver_disease": "moderate_or_severe_liver_disease",
    "malignancy": "metastatic_solid_tumor",
}
#: Fixed: labels of the source lists and the conditions that they mean.
LABELS = {
    "Myocardial infarction": "myocardial_infarction",
    "Congestive heart failure": "congestive_heart_failure",
    "Peripheral vascular disease": "peripheral_vascular_disease",
    "Cerebrovascular disease": "cerebrovascular_disease",
    "Dementia": "dementia",
    "Chronic pulmonary disease": "chronic_pulmonary_disease",
    "Rheumatic disease": "rheumatic_disease",
    "Peptic ulcer disease": "peptic_ulcer_disease",
    "Mild liver disease": "mild_liver_disease",
    "Hemiplegia or paraplegia": "hemiplegia_or_paraplegia",
    "Renal disease": "renal_disease",
    "Moderate or severe liver disease": "moderate_or_severe_liver_disease",
    "Metastatic solid tumor": "metastatic_solid_tumor",
    "AIDS/HIV": "aids_hiv",
    "Diabetes without chronic complication": "diabetes_without_complication",
    "Diabetes with chronic complication": "diabetes_with_complication",
    "Any malignancy, including lymphoma and leukemia, except malignant neoplasm of skin": "malignancy",
    "Diabetes, without chronic complications": "diabetes_without_complication",
    "Diabetes, with chronic complications": "diabetes_with_complication",
    "Malignancy, except skin neoplasms": "malignancy",
}
#: Fixed: drugs that stand for a condition.
DRUGS = {
    "chronic_pulmonary_disease": [
        "beclometasone",
        "budesonide",
        "fluticasone",
        "beclometasone-formoterol",
        "budesonide-formoterol",
        "fluticasone-salmeterol",
        "fluticasone-vilanterol",
        "fluticasone-formoterol",
        "tiotropium",
        "glycopyrronium",
        "aclidinium",
        "umeclidinium",
        "glycopyrronium-indacaterol",
        "umeclidinium-vilanterol",
        "fluticasone/umeclidinium/vilanterol",
        "beclometasone/formoterol/glycopyrronium",
    ],
    "diabetes_without_complication": ["gliclazide", "linagliptin", "sitagliptin", "alogliptin"],
}
#: Fixed: assignments of the SNOMED source that are left out.
EXCLUDED_SNOMED = [("metastatic_solid_tumor", "372087000"), ("dementia", "713571008")]
#: Fixed: the one code that may have several conditions.
REVIEWED_SNOMED = {"194781004": {"congestive_heart_failure", "renal_disease"}}
#: Fixed: rounded source code, concept that it must come with, repaired code.
SNOMED_REPAIRS = [
    ("1082601000119100", "46269816", "1082601000119104"),
    ("1082621000119100", "46269818", "1082621000119108"),
    ("1085021000119100", "46269835", "1085021000119106"),
    ("1085091000119100", "46269836", "1085091000119108"),
    ("1092801000119100", "46273476", "1092801000119102"),
    ("10692681000119100", "46269801", "10692681000119108"),
    ("10708511000119100", "45770892", "10708511000119108"),
    ("1073711000119100", "42534834", "1073711000119105"),
    ("1073721000119100", "42534835", "1073721000119103"),
    ("1073741000119100", "35609009", "1073741000119109"),
    ("1073751000119100", "36685020", "1073751000119106"),
    ("1073771000119100", "36685022", "1073771000119102"),
    ("1073791000119100", "42534836", "1073791000119101"),
    ("1073811000119100", "37108591", "1073811000119102"),
    ("1073821000119100", "35609010", "1073821000119109"),
    ("1073831000119100", "36685024", "1073831000119107"),
    ("12236951000119100", "36717006", "12236951000119108"),
    ("12236991000119100", "35611566", "12236991000119103"),
    ("12237111000119100", "36712805", "12237111000119107"),
    ("12237191000119100", "36712806", "12237191000119103"),
    ("12237231000119100", "36712807", "12237231000119107"),
    ("15649901000119100", "36717279", "15649901000119104"),
    ("15649941000119100", "35615028", "15649941000119102"),
    ("15649991000119100", "36712963", "15649991000119105"),
    ("15713081000119100", "46270162", "15713081000119108"),
    ("15713121000119100", "46270163", "15713121000119105"),
    ("15928141000119100", "36687122", "15928141000119107"),
    ("16276361000119100", "37109056", "16276361000119109"),
    ("16837681000119100", "37309626", "16837681000119104"),
]

#: Columns of the source tables, read as text.
DIAGNOSES = ("subject", "spell_identifier", "diagnosis_date", "diagnosis_code_icd", "diagnosis_code_snomed", "diagnosis_desc_icd", "diagnosis_desc_snomed")
PROBLEMS = ("subject", "problem_code", "problem_desc", "problem_dt_tm")
PRESCRIPTIONS = ("subject", "medication_name_short", "therapeutical_class", "order_dt_tm", "admission_medicine_y_n", "gp_to_continue")
EPISODES = ("subject", "infection_id", "spell_id", "admission_date", "first_culture_dt")
#: The common schema of evidence: column and type.
EVIDENCE = {
    "subject": "string",
    "spell_id": "string",
    "comorbidity_date": "timestamp_ntz",
    "source": "string",
    "icd_code": "string",
    "snomed_code": "string",
    "medication_name": "string",
    "event_date_imputed": "int",
}
#: How each source's columns are called in the common schema.
SOURCE_COLUMNS = {
    "diagnoses": {"spell_identifier": "spell_id", "diagnosis_date": "comorbidity_date", "diagnosis_code_icd": "icd_code", "diagnosis_code_snomed": "snomed_code"},
    "problems": {"problem_dt_tm": "comorbidity_date", "problem_code": "snomed_code"},
    "prescriptions": {"order_dt_tm": "comorbidity_date", "medication_name_short": "medication_name"},
}
#: Fixed: therapeutic classes of the warehouse extract, lower case.
THERAPEUTIC_CLASSES = (
    "cardiovascular agents",
    "central nervous system agents",
    "coagulation modifiers",
    "gastrointestinal agents",
    "genitourinary tract agents",
    "hormones/hormone modifiers",
    "metabolic agents",
    "miscellaneous agents",
    "none",
    "nutritional products",
    "respiratory agents",
    "topical agents",
)
