"""The published column contract: names in order, with their types. The names are the interface."""

COLUMNS = [
    ("site", "string"), ("dump_snapshot_date", "date"), ("question_id", "string"), ("question_url", "string"), ("question_creation_datetime", "string"), ("question_last_edit_datetime", "string"), ("question_title", "string"), ("question_body_html", "string"), ("question_body_text", "string"),
    ("question_tags_raw", "string"), ("question_tags", "string"), ("question_content_license", "string"), ("owner_user_id", "string"), ("owner_display_name", "string"), ("question_score", "bigint"), ("question_view_count", "bigint"), ("stackexchange_answer_count", "bigint"), ("has_stackexchange_answer", "boolean"), ("stackexchange_comment_count", "bigint"),
    ("accepted_answer_id", "string"), ("closed_datetime", "string"), ("question_word_count", "bigint"), ("code_character_count", "bigint"), ("code_line_count", "bigint"), ("link_count", "bigint"), ("image_count", "bigint"), ("tag_count", "bigint"), ("available_answer_count", "bigint"), ("has_available_answer", "boolean"),
    ("first_answer_id", "string"), ("first_answer_creation_datetime", "string"), ("time_to_first_answer_hours", "double"), ("median_answer_response_hours", "double"), ("accepted_answer_available", "boolean"), ("accepted_answer_creation_datetime", "string"), ("accepted_answer_url", "string"), ("accepted_answer_owner_user_id", "string"),
    ("accepted_answer_owner_display_name", "string"), ("accepted_answer_content_license", "string"), ("time_to_eventually_accepted_answer_post_hours", "double"), ("acceptance_date", "date"), ("days_to_acceptance", "bigint"), ("accepted_answer_score", "bigint"), ("accepted_answer_body_text", "string"), ("answer_score_spread", "bigint"),
    ("accepted_answer_score_rank", "bigint"), ("available_question_comment_count", "bigint"), ("comments_before_first_answer", "bigint"), ("observation_days_at_dump", "bigint"),
]
NAMES = [n for n, _ in COLUMNS]

#: The selectable summary fields, in order, as name, record, attribute.
SUMMARY = [
    ("question_id", "question", "id"), ("question_title", "question", "title"), ("question_body", "question", "body"), ("question_date", "question", "creation_date"), ("question_last_edit_date", "question", "last_edit_date"), ("question_tags", "question", "tags"), ("question_score", "question", "score"), ("question_view_count", "question", "view_count"), ("question_answer_count", "question", "answer_count"),
    ("question_comment_count", "question", "comment_count"), ("question_closed_date", "question", "closed_date"), ("question_owner_user_id", "question", "owner_user_id"), ("first_comment_id", "first_comment", "id"), ("first_comment_text", "first_comment", "text"), ("first_comment_date", "first_comment", "creation_date"), ("first_comment_score", "first_comment", "score"), ("first_comment_user_id", "first_comment", "user_id"), ("first_answer_id", "first_answer", "id"),
    ("first_answer_body", "first_answer", "body"), ("first_answer_date", "first_answer", "creation_date"), ("first_answer_score", "first_answer", "score"), ("first_answer_owner_user_id", "first_answer", "owner_user_id"), ("accepted_answer_id", "question", "accepted_answer_id"), ("accepted_answer_body", "accepted_answer", "body"), ("accepted_answer_date", "accepted_answer", "creation_date"), ("accepted_answer_score", "accepted_answer", "score"), ("accepted_answer_owner_user_id", "accepted_answer", "owner_user_id"),
]

#: The distributions shown, as figure, title, column, coverage, signed, whole numbers.
DISTRIBUTIONS = [
    ("5a", "Question score", "question_score", 0.99, True, True), ("5b", "Question views", "question_view_count", 0.95, False, True), ("5c", "Question prose length", "question_word_count", 0.99, False, True), ("5d", "Code volume", "code_character_count", 0.95, False, True),
    ("5e", "Links in the question", "link_count", 0.99, False, True), ("5f", "Question comments", "available_question_comment_count", 0.99, False, True), ("6a", "Available answers", "available_answer_count", 0.99, False, True), ("6b", "Time to first answer", "time_to_first_answer_hours", 0.90, False, False), ("6c", "Typical answer arrival", "median_answer_response_hours", 0.90, False, False),
    ("6d", "Accepted-answer post delay", "time_to_eventually_accepted_answer_post_hours", 0.90, False, False), ("6e", "Acceptance-action delay", "days_to_acceptance", 0.90, False, True), ("6f", "Comments before first answer", "comments_before_first_answer", 0.99, False, True), ("6g", "Answer-score spread", "answer_score_spread", 0.95, False, True),
]

#: Measurements whose high values are flagged, and their names.
FLAGGED = {
    "question_view_count": "Question views", "question_word_count": "Question prose words", "code_character_count": "Code characters", "available_answer_count": "Available answers", "available_question_comment_count": "Question comments", "time_to_first_answer_hours": "Hours to first answer", "time_to_eventually_accepted_answer_post_hours": "Hours to accepted-answer post", "answer_score_spread": "Answer-score spread",
}

#: Measurements that are correlated, and their names; a pair that is left out since images are links as a rule.
CORRELATED = {
    "question_word_count": "Prose words", "code_character_count": "Code characters", "link_count": "Links", "image_count": "Images", "tag_count": "Tags", "question_score": "Question score", "question_view_count": "Views", "available_answer_count": "Available answers", "available_question_comment_count": "Question comments", "comments_before_first_answer": "Comments before first answer", "time_to_first_answer_hours": "Hours to first answer",
    "median_answer_response_hours": "Median answer delay", "time_to_eventually_accepted_answer_post_hours": "Hours to accepted-answer post", "days_to_acceptance": "Days to acceptance", "answer_score_spread": "Answer-score spread", "observation_days_at_dump": "Observation days",
}
STRUCTURAL = [("link_count", "image_count")]
