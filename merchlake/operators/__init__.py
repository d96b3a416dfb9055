"""Relational building blocks shared by the reports and change flows."""

from merchlake.operators.bounded import asked_for, computed_once, look_up, written_once
from merchlake.operators.documents import as_document, one_row, rows_as_list
from merchlake.operators.images import attach_images, image_lists
from merchlake.operators.paging import DIRECT_RANKS, deep_page, envelope, first_rows, page, page_after, page_per
from merchlake.operators.rules import Rule, not_empty, reject_split, validate, with_errors
from merchlake.operators.winners import first_request, last_given

__all__ = [
    "DIRECT_RANKS", "Rule", "as_document", "asked_for", "attach_images", "computed_once", "deep_page", "envelope",
    "first_request", "first_rows",
    "image_lists", "last_given", "look_up", "not_empty", "one_row", "page", "page_after", "page_per", "reject_split",
    "rows_as_list", "validate", "with_errors", "written_once",
]
