"""Recode maps and labels.

Fixed values: these codes and numbers must equal those of the release
questionnaires and of the published analysis for results to agree.
"""

LIVES_WITH_V2 = {
    "both_parents": 0,
    "one_parent": 1,
    "other_relatives": 2,
    "other": 3,
    "foster": 4,
    "group/residential_setting": 5,
    "-": None,
}

EDUCATION = {
    "did_not_attend_high_school": 0,
    "some_high_school": 1,
    "ged_diploma": 2,
    "high_school_graduate": 3,
    "trade_school": 4,
    "some_college": 5,
    "associate_degree": 6,
    "baccalaureate_degree": 7,
    "graduate_or_professional_degree": 8,
}

LIVES_WITH = {
    "both_biological_parents": 0,
    "both_joint": 1,
    "biological_mother": 2,
    "biological_mother_and_stepfather": 3,
    "biological_father": 4,
    "biological_father_and_stepmother": 5,
    "adoptive_parent": 6,
    "other_relative": 7,
    "foster_parent": 8,
    "group_or_residential_setting": 9,
    "-": None,
}

INCOME = {
    "less_than_20000": 0,
    "21000_35000": 1,
    "36000_50000": 2,
    "51000_65000": 3,
    "66000_80000": 4,
    "81000_100000": 5,
    "101000_130000": 6,
    "131000_160000": 7,
    "over_161000": 8,
}

HAND = {"right": 0, "left": 1, "ambi": 2, "not_able": 3}

SOCIAL_COMPETENCE = {
    "above_average": 0,
    "average": 1,
    "below_average": 2,
    "failing": 3,
    "none": 3,
    "1": 2,
    "2_3": 1,
    "4_more": 0,
    "less_1": 2,
    "1_2": 1,
    "3_more": 0,
    "worse": 2,
    "better": 0,
    "has no brothers or sisters": 1,
}

GENDER = {"female": 0, "male": 1, "other": 2}

MULTIPLE_BIRTH = {"no": 0, "twin": 1, "triplet_other": 2}

GRADE = {
    "not_in_school": 0,
    "preschool": 1,
    "kindergarten": 2,
    "ungraded": 3,
    "1": 4,
    "2": 5,
    "3": 6,
    "4": 7,
    "5": 8,
    "6": 9,
    "7": 10,
    "8": 11,
    "9": 12,
    "10": 13,
    "11": 14,
    "12": 15,
    "post_secondary_special_education_or_vocational_programming": 16,
    "college": 17,
}

SEX = {"Female": 0, "Male": 1}

DISPLAY_LABELS = {"CBCL_6_18": "CBCL/6–18"}

METRIC_LIMITS = {
    "inertia": (0, None),
    "silhouette_score": (-1, 1),
    "davies_bouldin_score": (0, None),
    "calinski_harabasz_score": (0, None),
}
# End of fixed values.
