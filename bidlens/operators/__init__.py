"""The library's operators; what a user of it calls. `checklist` and `requirements` are modules, with the functions of these names in them."""

from .checklist import outreach, playbook_code
from .chunking import Packing, chunks, ending, paragraphs, sectioned
from .embedding import Backend, Hashed, nearest, ranked, relevance
from .drafts import Drafts
from .knowledge import added, contextual_chunks, described, document_texts, embedded, in_categories, loaded, numbered_chunks, rebuilt, recategorised, rechunked, reindexed, saved
from .mining import bigrams, broad_terms, chosen_queries, query_candidates, term_stats, terms
from .pricing import price_histogram, price_summary, ranked_awards
from .proposal import Section, compliance_evidence, compliance_matrix, draft_markdown, exemplar, gathered, matrix_markdown, outline, scaffolds, solicitation_index, title_page
from .records import awardee, description, error_detail, exported, extracted, extracted_files, hierarchy_path, json_object, manual_notice, organisation_name, search_notices
from .requirements import mapped, matrix, status_counts
from .responses import Cache, fetched
from .search import Filters, first_seen, numbered_by, overlaid, page, pages
from .store import cache_stats, cached, daily_budget, latest, new_documents, updated, versions, without

__all__ = [name for name in dir() if not name.startswith("_")]
