"""Word lists, labels and patterns. All of them are fixed values: results depend on them as they stand."""

# Notice type codes and labels.
NOTICE_TYPES = {
    "o": "Solicitation",
    "k": "Combined Synopsis/Solicitation",
    "p": "Presolicitation",
    "r": "Sources Sought",
    "s": "Special Notice",
    "a": "Award Notice",
    "u": "Justification (J&A)",
    "i": "Intent to Bundle Requirements",
    "g": "Sale of Surplus Property",
}

# Set-aside codes and descriptions.
SET_ASIDES = {
    "SBA": "Total Small Business Set-Aside",
    "SBP": "Partial Small Business Set-Aside",
    "8A": "8(a) Set-Aside",
    "8AN": "8(a) Sole Source",
    "HZC": "HUBZone Set-Aside",
    "HZS": "HUBZone Sole Source",
    "SDVOSBC": "Service-Disabled Veteran-Owned Set-Aside",
    "SDVOSBS": "SDVOSB Sole Source",
    "WOSB": "Women-Owned Small Business Set-Aside",
    "WOSBSS": "WOSB Sole Source",
    "EDWOSB": "Economically Disadvantaged WOSB Set-Aside",
    "EDWOSBSS": "EDWOSB Sole Source",
    "LAS": "Local Area Set-Aside",
    "IEE": "Indian Economic Enterprise",
    "ISBEE": "Indian Small Business Economic Enterprise",
}

# Words that embeddings leave out.
EMBED_STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "be", "as", "at", "by", "this",
    "that", "it", "from", "will", "shall", "we", "our", "their", "they", "i", "you", "he", "she", "but", "not", "can",
]

# Words that make poor search queries.
QUERY_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "will", "shall", "are", "was", "were", "has", "have", "had",
    "not", "all", "any", "our", "their", "you", "your", "they", "them", "its", "his", "her", "she", "him", "proposal",
    "proposals", "government", "contract", "contractor", "contracts", "offeror", "offerors", "solicitation",
    "section", "sections", "page", "pages", "volume", "price", "pricing", "cost", "costs", "data", "company", "inc",
    "llc", "corporation", "corp", "may", "must", "should", "would", "include", "included", "including", "provided",
    "provides", "requirement", "requirements", "experience", "project", "projects", "year", "years", "date", "number",
    "table", "figure", "appendix", "attachment", "reference", "references", "task", "tasks", "scope", "statement",
    "request", "following", "described", "based", "ensure", "per", "via", "use", "used", "using", "within", "into",
    "upon", "also", "each", "between", "under", "over", "such", "these", "those", "which", "where", "when", "what",
    "who", "able", "ability", "quality", "schedule", "deliver", "delivery", "us", "u.s", "usa", "federal", "agency",
    "department", "office", "program", "provide", "providing", "team", "personnel", "staff", "approach", "plan",
    "phase", "effort", "current", "new", "existing", "various", "additional", "overall", "total", "general",
    "specific", "applicable", "appropriate", "located", "location", "site", "area", "areas", "region", "facility",
    "facilities",
]

# Places and buyers, which are no capabilities.
PLACE_STOPWORDS = [
    "north", "south", "east", "west", "central", "upper", "lower", "county", "city", "town", "river", "lake", "creek",
    "dam", "valley", "mountain", "mountains", "island", "bay", "harbor", "port", "fort", "base", "district",
    "regional", "national", "army", "navy", "marine", "marines", "force", "guard", "coast", "corps", "engineers",
    "command", "battalion", "brigade", "wing", "usace", "usarmy", "dod", "gsa", "va", "nasa", "doe", "dhs", "alabama",
    "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "hampshire",
    "jersey", "mexico", "york", "carolina", "dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "wisconsin", "wyoming", "columbia",
]

# Words that name a capability.
CAPABILITY_HINTS = [
    "construction", "engineering", "installation", "maintenance", "design", "integration", "testing", "commissioning",
    "fabrication", "inspection", "modernization", "upgrade", "upgrades", "replacement", "repair", "rehabilitation",
    "operations", "electrical", "mechanical", "civil", "structural", "power", "energy", "transmission",
    "distribution", "substation", "substations", "generation", "generator", "generators", "exciter", "excitation",
    "turbine", "switchgear", "relay", "protection", "controls", "control", "scada", "automation", "hydroelectric",
    "hydropower", "infrastructure", "cybersecurity", "network", "networking", "software", "hardware", "staffing",
    "logistics", "training", "consulting", "environmental", "welding", "hvac", "telecommunications", "fiber",
    "cabling", "instrumentation", "calibration", "procurement", "supply", "lines", "line", "grid", "voltage",
    "breaker", "transformer", "transformers", "motor", "motors", "pump", "pumps", "piping",
]

# Document types by the words that tell them, in order of precedence.
DOC_TYPE_RULES = [
    ("Resume", ["resume", "curriculum vitae", " cv "]),
    ("Statement of Work", ["statement of work", "performance work statement", "pws", "sow"]),
    ("Past Performance", ["past performance", "cpars", "reference contract"]),
    ("Capability Statement", ["capability statement", "capabilities statement", "core competencies"]),
    ("Pricing", ["price", "pricing", "cost proposal", "rate", "labor category"]),
    ("Certification", ["certification", "iso 9001", "cage code", "sam registration"]),
    ("Proposal", ["proposal", "technical volume", "section l", "section m"]),
]
DOC_TYPE_BY_CATEGORY = {
    "Past Performance": "Past Performance",
    "Capabilities": "Capability Statement",
    "Technical": "Technical Document",
    "Pricing": "Pricing",
    "Certifications": "Certification",
}

# Requirement categories by the phrases that tell them, in order of precedence, and their order of listing.
REQUIREMENT_RULES = [
    ("Section L", ["section l", "instructions to offeror", "submission"]),
    ("Section M", ["section m", "basis for award"]),
    ("Evaluation", ["evaluat"]),
    ("SOW (shall)", ["shall", "must"]),
]
REQUIREMENT_ORDER = ["Section M", "Evaluation", "Section L", "SOW (shall)", "Other"]
# Fixed value: what makes a sentence a requirement.
REQUIREMENT_WORDS = r"shall|must|will be evaluated|is required to|are required to|offeror[s]? (?:shall|must|will)|the government will evaluate"

# Where sentences end, what numbers a heading, and how long a heading and its label may be.
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
HEADING_NUMBER = r"(?:\d+(?:\.\d+)*|[IVXLCDM]+)[.)]\s+"
HEADING_LENGTHS, HEADING_WORDS = (3, 90), 12
CAPITAL_LETTERS, CAPITAL_WORDS = 0.6, 0.7

# The trailing blocks that prose drops, Markdown marks, and citations.
TRAILING_BLOCKS = [
    r"(?is)(?:\n\s*)+(?:#{1,4}\s*)?\*{0,2}Sources\*{0,2}\s*:.*",
    r"(?is)(?:\n\s*)+(?:#{1,4}\s*)?\*{0,2}(?:References|Citations|Bibliography|Works\s+Cited)\*{0,2}\s*:.*",
]
CITATION = r"\[(?:KB(?:\s+style)?|Solicitation)[^\]]*\]"

# What begins a line that names no company, and the legal forms that tell one.
NO_COMPANY = r"title page|volume|technical proposal|to:|subj:|ref:"
LEGAL_FORMS = r"LLC|L\.L\.C\.|INC|CORP|LTD"

# Queries that find what a solicitation demands.
COMPLIANCE_QUERIES = [
    "Section L instructions to offerors proposal submission requirements format page limit",
    "Section M evaluation criteria factors basis for award technical evaluation",
    "the contractor shall perform mandatory tasks requirements deliverables",
    "offeror must submit provide required documentation certifications registration",
]

# Statuses of a requirement and the least similarity for each.
STATUSES = ["Addressed", "Partial", "Not Addressed"]
ADDRESSED, PARTIAL = 0.58, 0.45
WEAK_EVIDENCE, RELEVANCE_FLOOR = 0.45, 0.30
HEADING_BONUS, TEMPLATE_BONUS = 0.18, 0.12
QUERY_BONUS, NAICS_BONUS = 0.03, 0.05

# Actions by notice type (action, detail, priority).
PLAYBOOK = {
    "r": [
        ("Decide whether to submit a capability statement", "Sources Sought / RFI responses are market research, not bids. Responding signals interest and can shape the eventual solicitation.", "high"),
        ("Tailor your capability statement to the stated requirement", "Mirror the keywords and NAICS in the notice; highlight relevant past performance.", "high"),
        ("Ask clarifying questions to the listed POC", "Use the contact(s) below to confirm scope, anticipated set-aside, and timeline.", "normal"),
    ],
    "p": [
        ("Confirm the anticipated solicitation release date", "Presolicitations announce an upcoming RFP/RFQ. Track when the solicitation drops.", "high"),
        ("Begin teaming / subcontractor outreach early", "Use the lead time before solicitation to line up partners and key personnel.", "normal"),
    ],
    "o": [
        ("Read Sections L (instructions) and M (evaluation) first", "These define how to submit and how you are scored. Build the proposal outline from Section M.", "high"),
        ("Build a compliance matrix from the SOW/PWS", "Extract every 'shall' requirement and map it to a proposal response.", "high"),
        ("Submit clarifying questions before the Q&A deadline", "Note the question cutoff; it is usually well before the proposal due date.", "high"),
        ("Verify registrations are active", "Confirm SAM.gov registration, required certs, and that the set-aside eligibility applies to you.", "normal"),
    ],
    "k": [
        ("Treat as a live solicitation — quote may be due soon", "Combined Synopsis/Solicitations (often FAR 13 simplified) can have short turnarounds.", "high"),
        ("Build a line-item compliant quote", "Address every CLIN and submission instruction exactly as stated.", "high"),
    ],
    "s": [
        ("Determine the notice's purpose", "Special Notices cover industry days, pre-bid conferences, or program updates. Identify the ask.", "normal"),
        ("Register for any event / RSVP", "If an industry day or site visit is mentioned, register before the stated cutoff.", "normal"),
    ],
    "a": [
        ("Capture competitive intelligence", "Record the awardee, amount, and NAICS for your pricing history and future bids.", "normal"),
        ("Consider a post-award debrief request (if you bid)", "If you competed and lost, request a debrief within the FAR-allowed window.", "normal"),
    ],
}
PLAYBOOK_TAIL = [
    ("Confirm submission method and format", "Check whether the response goes via email, SAM.gov, or a portal, and the required file formats.", "normal"),
    ("Download and review all attachments", "Pull every resource link (SOW/PWS, attachments, amendments) and scan for requirements.", "high"),
]

# Titles and details of the checklist's own items.
DEADLINE_PASSED, DEADLINE_AHEAD = "Deadline has passed — verify if still open", "Submit the response before the deadline"
REVIEW = ("Internal 'pencils down' / final review", "Reserve the final 48 hours for compliance review and submission mechanics.")
SET_ASIDE_CHECK = "Confirm set-aside eligibility"

# What a document that stands for a whole proposal is worth, by its kind, category and name; half a point a chunk up to the most.
TEMPLATE_KINDS = {"Proposal": 12.0, "Technical Document": 8.0}
TEMPLATE_PAST_PERFORMANCE, TEMPLATE_PAST_CHUNKS = 10.0, 5
TEMPLATE_CATEGORIES, TEMPLATE_CATEGORY = ("Technical", "Past Performance"), 4.0
TEMPLATE_NAMES, TEMPLATE_NAME = ("proposal", "excitation", "technical volume", "volume 1"), 6.0
TEMPLATE_SHORT_KINDS, TEMPLATE_SHORT_CHUNKS, TEMPLATE_SHORT = ("Capability Statement", "Pricing"), 3, -8.0
TEMPLATE_CARDS, TEMPLATE_CARD = ("line card", "capabilities statement"), -6.0
TEMPLATE_CHUNK, TEMPLATE_MOST_CHUNKS = 0.5, 25

# Tabs and appendices of a volume whose template names none, and the restriction on its title page.
TABS = [
    ("1", "Executive Summary"),
    ("2", "Equipment Drawings and Descriptive Data"),
    ("3", "Installation Plan"),
    ("4", "Technical Comments and Clarifications"),
    ("5", "Past Performance"),
    ("6", "Appendices"),
]
APPENDICES = [
    ("1", "Equipment Highlights / Product Description"),
    ("2", "Specification Guide / Technical Data"),
    ("3", "One-Line Diagram"),
    ("4", "Equipment Outline Drawing"),
    ("5", "Technical Standards and Certifications"),
    ("6", "HMI / Control System Information"),
    ("7", "Selected Screen Shots / Interface Examples"),
    ("8", "Quality Certification & Facility Capability"),
    ("9", "Product Description and Maintenance Procedures"),
    ("10", "Maintenance Schedule"),
    ("11", "Spare Parts List"),
]
RESTRICTION = (
    "This proposal includes data that shall not be disclosed outside the Government and shall not be duplicated, used, or disclosed — in whole or in part — for any purpose other than to evaluate this proposal. "
    "If, however, a contract is awarded to the offeror as a result of — or in connection with — the submission of this data, the Government shall have the right to duplicate, use, or disclose the data to the extent provided in the resulting contract. "
    "This restriction does not limit the Government's right to use information contained in this data if it is obtained from another source without restriction."
)

# A letter to a contact; what stands in braces is filled in.
LETTER_SUBJECT = "Question regarding {title} ({ref})"
LETTER = (
    "Dear {name},\n\n"
    "My name is {sender}, {sender_title} at {company}. I am writing regarding the opportunity \"{opportunity}\" ({ref}) posted by {agency}{naics}.\n\n"
    "{company} specializes in {capabilities}, which aligns closely with the requirement described in this notice. {deadline}We would welcome the opportunity to confirm a few details to ensure our response fully addresses your needs:\n\n"
    "  1. Could you confirm the preferred submission method and format?\n"
    "  2. Are there any anticipated amendments or a scheduled industry day?\n"
    "  3. Is the set-aside designation final as posted?\n\n"
    "Thank you for your time and for the information provided in this notice. Please let me know if a brief call would be helpful.\n\n"
    "Best regards,\n{sender}\n{sender_title}, {company}\n{email} | {phone}"
)
LETTER_DEADLINE = "We note the response deadline of {day}. "
LETTER_SOURCES = {"always": "opportunity metadata: title, solicitationNumber, agency", "naics": "opportunity metadata: naicsCode", "deadline": "opportunity metadata: responseDeadLine", "contact": "opportunity metadata: pointOfContact.fullName"}
