"""Instrument catalog of the clinical release layout the library can read out of the box.

Only names that must equal the file and column names of a release are stated
here; question columns follow one naming rule (``q`` + number + ``_``).
"""

from __future__ import annotations

from cohortloom.catalog import Catalog, Feature, Instrument

QUESTION_PATTERN = r"q\d{2,3}[a-z]?_"

# Subject key, instrument codes with file base names, subscale and score columns of a release.
SUBJECT_KEY = "subject_sp_id"

DCDQ_SUBSCALES = ("control_during_movement", "fine_motor_handwriting", "general_coordination")

RBSR_SUBSCALES = (
    "i_stereotyped_behavior_score",
    "ii_self_injurious_score",
    "iii_compulsive_behavior_score",
    "iv_ritualistic_behavior_score",
    "v_sameness_behavior_score",
    "vi_restricted_behavior_score",
)

CBCL_6_18_SUBSCALES = (
    "anxious_depressed_t_score",
    "withdrawn_depressed_t_score",
    "somatic_complaints_t_score",
    "social_problems_t_score",
    "thought_problems_t_score",
    "attention_problems_t_score",
    "rule_breaking_behavior_t_score",
    "aggressive_behavior_t_score",
    "internalizing_problems_t_score",
    "externalizing_problems_t_score",
    "obsessive_compulsive_problems_t_score",
    "sluggish_cognitive_tempo_t_score",
    "stress_problems_t_score",
    "dsm5_conduct_problems_t_score",
    "dsm5_somatic_problems_t_score",
    "dsm5_oppositional_defiant_t_score",
    "dsm5_attention_deficit_hyperactivity_t_score",
    "dsm5_anxiety_problems_t_score",
    "dsm5_depressive_problems_t_score",
)

CBCL_1_5_SUBSCALES = (
    "emotionally_reactive_t_score",
    "anxious_depressed_t_score",
    "somatic_complaints_t_score",
    "withdrawn_t_score",
    "sleep_problems_t_score",
    "attention_problems_t_score",
    "aggressive_behavior_t_score",
    "internalizing_problems_t_score",
    "externalizing_problems_t_score",
    "stress_problems_t_score",
    "dsm5_depressive_problems_t_score",
    "dsm5_anxiety_problems_t_score",
    "dsm5_autism_spectrum_problems_t_score",
    "dsm5_attention_deficit_hyperactivity_t_score",
    "dsm5_oppositional_defiant_t_score",
)

PLAIN_INSTRUMENTS = (
    ("bms", "basic_medical_screening"),
    ("aci", "approximated_cognitive_impairment"),
    ("adi", "area_deprivation_index"),
    ("asr", "asr"),
    ("bha", "background_history_adult"),
    ("bhc", "background_history_child"),
    ("bhs", "background_history_sibling"),
    ("clr", "clinical_lab_results"),
    ("cdv", "core_descriptive_variables"),
    ("ir", "individuals_registration"),
    ("iq", "iq"),
    ("roles", "roles"),
    ("srgd", "self_reported_genetic_diagnosis"),
    ("srs_2_asr", "srs-2_adult_self_report"),
    ("srs_2_DA", "srs2_dependent_adult"),
    ("srs_2_sa", "srs2_school_age"),
    ("v3", "vineland-3"),
    ("ados_o_1", "ados/ados_original_module_1"),
    ("ados_o_2", "ados/ados_original_module_2"),
    ("ados_o_3", "ados/ados_original_module_3"),
    ("ados_o_4", "ados/ados_original_module_4"),
    ("ados_2_t", "ados/ados_2_toddler"),
    ("ados_2_1", "ados/ados_2_module_1"),
    ("ados_2_2", "ados/ados_2_module_2"),
    ("ados_2_3", "ados/ados_2_module_3"),
    ("ados_2_4", "ados/ados_2_module_4"),
)

# Columns the child and sibling background histories share and the preparation keeps.
HISTORY_COLUMNS = (
    "age_at_eval_years",
    "survey_version",
    "child_lives_with",
    "child_lives_with_v2",
    "gender",
    "mother_highest_education",
    "father_highest_education",
    "annual_household_income",
    "smiled_age_mos",
    "sat_wo_support_age_mos",
    "crawled_age_mos",
    "walked_age_mos",
    "fed_self_spoon_age_mos",
    "used_words_age_mos",
    "combined_words_age_mos",
    "combined_phrases_age_mos",
    "bladder_trained_age_mos",
    "bowel_trained_age_mos",
    "hand",
    "child_grade_school",
    "repeat_grade",
    "sped_y_n",
    "twin_mult_birth",
    "zygosity",
    "twin_asd",
    "twin_partic",
    "bghx_validity_flag",
    "eval_year",
)

SCQ_EXTRA_COLUMNS = ("missing_values", "sex", "asd", "age_at_eval_years")
RBSR_EXTRA_COLUMNS = ("missing_values", "age_at_eval_years")
CBCL_6_18_SOCIAL_COLUMNS = (
    "close_friends",
    "contact_friends_outside_school",
    "gets_along_siblings",
    "gets_along_other_kids",
    "behave_with_parents",
    "play_work_alone",
)
# End of fixed values.


def release_catalog() -> Catalog:
    """The instruments of a release; call ``resolved`` with the table columns to fill question roles."""
    scored = [
        Instrument("dcdq", "dcdq", None, DCDQ_SUBSCALES, "final_score", QUESTION_PATTERN),
        Instrument("rbsr", "rbsr", None, RBSR_SUBSCALES, "total_final_score", QUESTION_PATTERN),
        Instrument("scq", "scq", None, None, "final_score", QUESTION_PATTERN),
        Instrument("cbcl_6_18", "cbcl_6_18", None, CBCL_6_18_SUBSCALES, "total_problems_t_score", QUESTION_PATTERN),
        Instrument("cbcl_1_5", "cbcl_1_5", None, CBCL_1_5_SUBSCALES, "total_problems_t_score", QUESTION_PATTERN),
    ]
    return Catalog([*scored, *(Instrument(code, path) for code, path in PLAIN_INSTRUMENTS)], SUBJECT_KEY)


def preparation_features(catalog: Catalog) -> dict[str, list[Feature]]:
    """Feature lists of the cohort preparation, built by rule from a resolved catalog.

    The SCQ list leaves out the first question, which gates the others; the CBCL list leaves out a free-text one.
    """
    scq, rbsr, cbcl = (catalog.from_code(c) for c in ("scq", "rbsr", "cbcl_6_18"))
    columns = {
        "SCQ": (*SCQ_EXTRA_COLUMNS, *(q for q in scq.questions or () if not q.startswith("q01_")), scq.final_score),
        "RBSR": (*RBSR_EXTRA_COLUMNS, *(rbsr.questions or ()), *rbsr.subscales),
        "CBCL_6_18": (*CBCL_6_18_SOCIAL_COLUMNS, *(q for q in cbcl.questions or () if q != "q056_h_other"), *cbcl.subscales, cbcl.final_score),
        "BHC": HISTORY_COLUMNS,
        "BHS": HISTORY_COLUMNS,
    }
    return {code: [Feature(code, c) for c in cols] for code, cols in columns.items()}
