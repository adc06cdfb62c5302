"""Fixed values.

Word lists, weights, thresholds and patterns that define the results of the text and
ranking operators.  They are plain values in natural order; change them only together
with the expected results.
"""

# ---- lexical coverage stop words (English and Tagalog function words) -------------
COVERAGE_STOP_WORDS = """
a an the of to for in on at and or with from by as is are was were be been being do does did has have had
can could should would will what which who when where why how give show return state tell please only all any
this that these those it its often under must every according
ang ng mga sa ay at na nang para ano anong sino alin kailan saan bakit paano gaano dapat ayon lahat ito iyon nito
niya nila ba din rin
""".split()

# ---- query topic filler words -----------------------------------------------------
QUERY_FILLER_WORDS = """
the a an of in on for to and or with about what who when where why how is are was were can you please explain
describe tell me detail details definition overview description summary background important information key facts
biography life known
""".split()

# ---- file name filler words --------------------------------------------------------
FILE_FILLER_WORDS = """
the a an of in on for to and or with about wikipedia frominternet pdf docx txt
""".split()

# ---- relevance feedback stop words ---------------------------------------------------
FEEDBACK_STOP_WORDS = "the a an and or of to for in on with is are was were this that it".split()

# ---- phrase signals, matched as whole words in normalised text -----------------------
DEFINITION_SIGNALS = [
    "was a", "was an", "is a", "is an", "was the", "is the", "refers to", "known as", "known for", "served as",
    "born", "died", "filipino", "nationalist", "writer", "polymath", "employee", "employees", "policy", "procedure",
    "standard", "requirement", "requirements", "must", "shall",
]
REFERENCE_NOISE_TERMS = [
    "retrieved", "archived", "archive", "http", "https", "www", "isbn", "issn", "doi", "references",
    "external links", "bibliography", "further reading", "web archive", "wayback machine", "google", "abs cbn",
    "gma news", "inquirer", "news",
]
IDENTITY_NOISE_TERMS = [
    "monument", "statue", "park", "located at", "unveiled", "gift from", "community of", "city of", "film",
    "tv series", "portrayed", "actor", "actress", "plays", "book", "books", "authored", "google books", "retrieved",
    "archived", "references", "bibliography", "external links", "further reading", "isbn", "issn", "doi", "http",
    "https", "www",
]
IDENTITY_QUERY_TERMS = [
    "biography", "profile", "description", "described", "identified", "life", "known for", "important facts",
    "who is", "who was", "sino si", "sino ang",
]
BIOGRAPHY_SIGNALS = [
    "filipino nationalist", "writer and polymath", "ophthalmologist", "national hero", "propaganda movement", "born",
    "died", "execution", "spanish colonial period", "political reforms",
]
REFERENCE_REQUEST_TERMS = [
    "citation", "citations", "reference", "references", "bibliography", "external links", "source list",
    "sources list", "works cited",
]
REFERENCE_HEADINGS = [
    "citation", "citations", "reference", "references", "bibliography", "external links", "further reading",
    "sources", "source", "notes", "works cited",
]
INTRO_SIGNALS = [
    "was a", "was an", "is a", "is an", "was the", "is the", "filipino", "employee", "employees", "policy",
    "procedure",
]
STRONG_INTRO_SIGNALS = [
    "was a", "was an", "is a", "is an", "was the", "is the", "was a filipino", "was an filipino",
    "filipino nationalist", "writer and polymath", "born", "died",
]
STRONG_INTRO_FILLER = (
    "biography life known for background important facts overview summary description".split()
)
RELATIONSHIP_WEIGHTS = {
    "relationship": 1.20, "relationships": 1.20, "romantic": 1.20, "romance": 1.20, "love": 1.00, "lover": 1.00,
    "sweetheart": 1.40, "courtship": 1.30, "courted": 1.20, "girlfriend": 1.20, "girlfriends": 1.20, "wife": 1.50,
    "common law wife": 1.80, "married": 1.20, "marriage": 1.20, "fiancee": 1.20, "fiance": 1.20, "engaged": 1.10,
    "women": 0.90, "woman": 0.90, "ladies": 0.90, "lady": 0.90, "personal life": 0.90, "common law": 1.20,
    "partner": 1.00, "spouse": 1.00, "beloved": 1.00, "affection": 0.90, "suitor": 0.90, "admirer": 0.90,
    "daughter": 0.70, "family": 0.50,
}
RELATIONSHIP_NEGATIVE_TERMS = [
    "monument", "monuments", "statue", "park", "popular culture", "film", "tv series", "portrayed", "actor",
    "actress", "frigate", "ship", "coin", "bust", "painting", "portrait", "opera", "movie", "awards",
    "external links", "references", "bibliography", "further reading", "retrieved", "archived", "http", "https",
    "www",
]
RELATIONSHIP_SECTION_SIGNALS = [
    "personal life", "early life", "education", "women", "relationship", "relationships", "marriage", "wife",
    "family",
]
LIST_CUE_PATTERN = (
    "requirements?|steps?|items?|names?|employees?|records?|positions?|departments?|options?|categories?|types?|rules?"
)

# ---- retrieval intent patterns --------------------------------------------------------
# Question starters.
LIST_PREFIX_PATTERNS = [
    r"^(who are|what are)\b",
    r"^(list|enumerate)\b",
    r"^name the\b",
    r"^give me the list\b",
    r"^(?:give|show|return|provide)\s+(?:the\s+)?(?:two|three|four|five|six|seven|eight|nine|ten|\d+)\b",
    r"^(?:give|show|return|provide)\s+(?:the\s+)?(?:names?|records?|entries|items|employees?|people|requirements?|steps?|rules?|options?|values?)\b",
    r"^(sino sino|ano ano|ilista)\b",
    r"^(all|examples|types|categories)\b",
    r"^how to\b",
    r"^step by step\b",
    r"^steps\b",
    r"^procedure for\b",
    r"^procedures for\b",
    r"^process for\b",
    r"^workflow for\b",
]
COMPLETENESS_TERMS = (
    "steps requirements rules conditions exceptions approvers parameters options commands errors".split()
)
LIST_RELATION_PATTERN = (
    r"\b(ladies|women|relationships?|romantic relationships?|love interests?|girlfriends?|personal life"
    r"|associated women|connected to|associated with)\b"
)
RELATIONSHIP_QUERY_PATTERN = (
    r"\b(ladies|women|relationships?|romantic|love interests?|girlfriends?|personal life|spouses?|wives?|husbands?)\b"
)
INTERROGATIVES = "who|what|when|where|why|how|which|sino|ano|anong|kailan|saan|bakit|paano|alin"
IMPERATIVES = (
    "explain|describe|summari[sz]e|define|list|enumerate|give|show|provide|tell|clarify|elaborate"
    "|ipaliwanag|ilarawan|ibuod|ilista|ibigay"
)
# Comparisons of two events.
TEMPORAL_COMPARISON_PATTERNS = [
    r"\b(?:before|after|earlier|later)\b.+\bthan\b",
    r"\b(?:before\s+or\s+after)\b",
    r"^\s*(?:was|is|did)\s+.+\s+(?:before|after|earlier\s+than|later\s+than)\s+.+$",
    r"\b(?:nauna|sumunod)\b.+\bkaysa\b",
    r"\bmas\s+nauna\b.+\bkaysa\b",
    r"^\s*which\s+came\s+(?:later|first|earlier)\s*:",
    r"^\s*alin\s+ang\s+(?:nauna|sumunod)\s*:",
    r"^\s*compare\s+.+\s+(?:with|to|and)\s+.+\b(?:date|dates|first|earlier|later|chronological)\b",
    r"\bchronological\s+order\b.*?:\s*.+\s+(?:and|or|at|o)\s+.+",
]
FACET_PAIR_PATTERNS = [
    r"^\s*(?:mas\s+)?(?:nauna|sumunod)\s+(?:ba\s+)?(.+?)\s+kaysa\s+(.+?)[?!.]*$",
    r"^\s*alin\s+ang\s+(?:nauna|sumunod)\s*:\s*(.+?)\s+(?:o|or)\s+(.+?)[?!.]*$",
    r"^\s*(?:was|is|did)\s+(.+?)\s+(?:before\s+or\s+after|before|after|earlier\s+than|later\s+than)\s+(.+?)[?!.]*$",
    r"^\s*which\s+came\s+(?:later|first|earlier)\s*:\s*(.+?)\s+or\s+(.+?)[?!.]*$",
    r"^\s*compare\s+(.+?)\s+(?:with|to|and)\s+(.+?)(?:[.?!]|$)",
    r"^\s*(?:put|place|arrange|order)\b.*?\bchronological\s+order\b.*?:\s*(.+?)\s+(?:and|or|at|o)\s+(.+?)(?:[.?!]|$)",
]
FACET_ANCHOR_STOP_WORDS = """
who what when where why how which sino ano anong kailan saan bakit paano alin is are was were be been being do does
did can could should would will has have had the a an of to for in on at and or about say says said tell me please
explain describe
""".split()
FACET_PRONOUNS = "he she it they them his her its their siya nito niya nila".split()

# ---- relation kinds, first match wins ---------------------------------------------------
# One pattern per kind.
RELATION_KIND_PATTERNS = [
    (
        "organization",
        r"\b(?:organization|organisation|group|association|society|movement)\b"
        r".*\b(?:found|founded|cofound|co founder|co founded|help found|helped found)\b"
        r"|\b(?:found|founded|cofound|co founder|co founded|help found|helped found)\b"
        r".*\b(?:organization|organisation|group|association|society|movement)\b",
    ),
    (
        "position",
        r"\b(?:position|role|office|title)\b.*\b(?:hold|held|have|serve|served|occupy|occupied)\b"
        r"|\b(?:hold|held|serve|served|appointed)\b.*\b(?:position|role|office|title)\b",
    ),
    ("approver", r"\b(?:approve|approves|approved|approval|approver|authorize|authorizes|authorization)\b"),
    (
        "quantity",
        r"\b(?:how many|how much|number|amount|limit|allotment|allowance|entitlement|annual|annually|yearly|days?|hours?|credits?|percentage|percent)\b",
    ),
    ("purpose", r"\b(?:purpose|objective|goal|aim|mission)\b"),
    ("eligibility", r"\b(?:eligible|eligibility|qualified|qualification|qualify|qualifies|entitled|entitlement|covered)\b"),
    ("time", r"\b(?:when|date|year|signed|effective|deadline|issued|started|ended|approved on)\b"),
    ("winner", r"\b(?:won|winner|winners|winning|awarded\s+to)\b"),
]
RELATION_COMMON_WORDS = """
the a an of in on at for to and or with what which who when where why how did does do is are was were has have had
its his her their he she they it this that from by as be been
""".split()
RELATION_KIND_WORDS = {
    "position": "position role office title hold held serve served occupy occupied appointed appointment",
    "organization": "organization organisation group association society movement found founded founder founding "
                    "cofound help helped",
    "approver": "approve approves approved approval approver authorize authorizes authorized authorization required "
                "requires require",
    "quantity": "many much number amount limit allotment allowance annual annually yearly day days hour hours credit "
                "credits percentage percent provided provide provides given give entitled entitlement",
    "purpose": "purpose objective goal aim mission main primary organized organised formed created pursue pursued "
               "seek sought intended outcome",
    "eligibility": "eligible eligibility qualified qualification qualify qualifies entitled entitlement covered "
                   "benefit benefits",
    "time": "date year signed sign effective deadline issued started start ended end approved",
    "winner": "won winner winners winning award awarded to",
}

# ---- question normalisation ----------------------------------------------------------------
QUESTION_PREFIX_PATTERNS = [
    r"^who\s+is\s+", r"^who\s+was\s+", r"^who\s+are\s+", r"^sino\s+si\s+", r"^sino\s+ang\s+", r"^what\s+is\s+",
    r"^what\s+was\s+", r"^what\s+are\s+", r"^where\s+is\s+", r"^where\s+was\s+", r"^when\s+is\s+", r"^when\s+was\s+",
    r"^tell\s+me\s+about\s+", r"^what\s+can\s+you\s+tell\s+me\s+about\s+", r"^give\s+me\s+information\s+about\s+",
    r"^provide\s+information\s+about\s+", r"^can\s+you\s+explain\s+", r"^can\s+you\s+tell\s+me\s+about\s+",
    r"^please\s+explain\s+", r"^explain\s+", r"^describe\s+", r"^define\s+", r"^summarize\s+",
]
_END = r"[?!.]*$"
# (pattern, replacement with numbered groups); the first matching row rewrites the question.
CANONICAL_QUESTIONS = [
    (r"^give\s+(?:me\s+)?(?:a\s+)?(?:short\s+|brief\s+|concise\s+)?(?:profile|description)\s+of\s+(.+?)"
     r"(?:\s+from\s+(?:the\s+)?(?:knowledge\s+base|company\s+knowledge|stored\s+material|stored\s+documents"
     r"|documents))?" + _END, r"\1 biography"),
    (r"^ano\s+ang\s+(.+?)\s+sa\s+(?:maikling|simpleng)\s+paliwanag" + _END, r"\1 description"),
    (r"^which\s+(?:two\s+)?countries\s+were\s+parties\s+to\s+(.+?)" + _END, r"countries that signed \1"),
    (r"^who\s+were\s+(?:the\s+)?(?:two\s+)?(?:national\s+)?parties\s+to\s+(.+?)" + _END, r"countries that signed \1"),
    (r"^sino\s+ang\s+(?:isa\s+sa\s+mga\s+)?nagtatag\s+(?:ng\s+)?(nito|niyan|niyon|ito|iyan|iyon)" + _END,
     r"founder \1"),
    (r"^(?:briefly\s+)?describe\s+(.+?)(?:\s+(?:briefly|in\s+a\s+sentence))?" + _END, r"\1 biography"),
    (r"^how\s+do\s+(?:the\s+)?(?:documents|stored\s+documents|stored\s+material)\s+identify\s+(.+?)" + _END,
     r"\1 biography"),
    (r"^how\s+is\s+(.+?)\s+(?:identified|described)\s+in\s+(?:the\s+)?(?:stored\s+material|stored\s+documents"
     r"|documents|knowledge\s+base)" + _END, r"\1 biography"),
    (r"^(?:what\s+is\s+)?(?:the\s+)?(?:yearly|annual)\s+(.+?)\s+(?:allotment|allowance|entitlement)"
     r"(?:\s+in\s+(?:the\s+)?(?:policy|document))?" + _END, r"annual \1 amount"),
    (r"^sino\s+ang\s+(?:isa\s+sa\s+mga\s+)?nagtatag\s+ng\s+(.+?)" + _END, r"founder \1"),
    (r"^sino[-\s]*sino\s+ang\s+(?:mga\s+)?nagtatag\s+ng\s+(.+?)" + _END, r"founders \1"),
    (r"^sino\s+(?:ang\s+)?(?:pwede|puwede|pwedeng|puwedeng|maaaring)\s+(?:gumamit|makagamit)\s+"
     r"(?:nitong|nito|ng|sa)?\s*(.+?)(?:\s+benefits?)?" + _END, r"\1 eligibility"),
    (r"^who\s+(?:can|may)\s+use\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^who\s+(?:is|are)\s+(?:eligible|qualified)\s+for\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^which\s+(.+?)\s+(?:is|are)\s+(?:eligible|qualified)\s+for\s+(.+?)" + _END, r"\2 eligibility \1"),
    (r"^(.+?)\s+(?:is|are)\s+(?:eligible|qualified)\s+for\s+(.+?)" + _END, r"\2 eligibility \1"),
    (r"^(?:eligible|qualified)\s+for\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^(?:eligibility|qualification)\s+for\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^who\s+qualifies\s+for\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^which\s+(.+?)\s+qualif(?:y|ies)\s+for\s+(.+?)" + _END, r"\2 eligibility \1"),
    (r"^who\s+(?:is|are)\s+covered\s+by\s+(.+?)" + _END, r"\1 eligibility"),
    (r"^who\s+(?:is|are)\s+entitled\s+to\s+(.+?)" + _END, r"\1 entitlement"),
    (r"^which\s+(.+?)\s+(?:is|are)\s+entitled\s+to\s+(.+?)" + _END, r"\2 entitlement \1"),
    (r"^entitled\s+to\s+(.+?)" + _END, r"\1 entitlement"),
    (r"^entitlement\s+to\s+(.+?)" + _END, r"\1 entitlement"),
    (r"^(?:okay\s*[,;:]?\s*)?sino\s+(?:naman\s+)?(?:ang\s+)?(?:nag[- ]?aapprove|nag[- ]?approve|umaapprove"
     r"|mag[- ]?approve|nag[- ]?aapruba|mag[- ]?apruba)(?:\s+(?:ng|sa)\s+(.+?))?" + _END, r"\1 approval"),
    (r"^kanino\s+(?:kailangang\s+)?(?:ipa[- ]?approve|ipa[- ]?apruba)\s+(.+?)" + _END, r"\1 approval"),
    (r"^who\s+(?:can\s+)?(?:approve|authorize)\s+(.+?)" + _END, r"\1 approval"),
    (r"^which\s+(.+?)\s+(?:can\s+)?(?:approve|authorize)\s+(.+?)" + _END, r"\2 approval \1"),
    (r"^who\s+(?:must|needs?\s+to|required\s+to)\s+(?:approve|authorize)\s+(.+?)" + _END, r"\1 approval"),
    (r"^whose\s+approval\s+is\s+required\s+for\s+(.+?)" + _END, r"\1 approval"),
    (r"^whose\s+approval\s+does\s+(.+?)\s+require" + _END, r"\1 approval"),
    (r"^which\s+(.+?)\s+must\s+(?:approve|authorize)\s+(.+?)" + _END, r"\2 approval \1"),
    (r"^who\s+(?:can|may)\s+(.+?)" + _END, r"\1 authorization"),
    (r"^which\s+(.+?)\s+(?:can|may)\s+(.+?)" + _END, r"\2 authorization \1"),
    (r"^who\s+(?:is|are)\s+(?:authorized|allowed|permitted)\s+to\s+(.+?)" + _END, r"\1 authorization"),
    (r"^who\s+(?:is|are)\s+responsible\s+for\s+(.+?)" + _END, r"\1 responsibility"),
    (r"^which\s+(.+?)\s+(?:is|are)\s+responsible\s+for\s+(.+?)" + _END, r"\2 responsibility \1"),
]
ABBREVIATIONS = {
    "vl": "vacation leave", "sl": "sick leave", "el": "emergency leave", "pl": "paternity leave",
    "ml": "maternity leave", "ot": "overtime", "hr": "human resources", "coe": "certificate of employment",
    "loa": "leave of absence", "dept": "department", "yr": "year",
}

# ---- enrichment intents and terms -----------------------------------------------------------
OVERVIEW_PATTERN = (
    r"\b(what can you tell me about|tell me about|explain|describe|give me an overview|overview of|summary of"
    r"|what is|ano ang|tungkol sa|ipaliwanag|pakiexplain|paki explain|ano ang tungkol sa)\b"
)
IDENTITY_PATTERN = (
    r"\b(who is|who was|sino si|sino ang|kilala si|kilala ang|profile of|brief profile|short profile"
    r"|concise profile|identify|identified in)\b"
)
ELIGIBILITY_PATTERN = (
    r"\b(eligible|eligibility|qualified|qualification|qualify|qualifies|covered)\b|\b(entitled|entitlement)\b"
    r"|\b(authorized|authorization|allowed|permission|permitted)\b|\bwho\s+(can|may)\b|\bwhich\s+.+?\s+(can|may)\b"
    r"|\b(responsible|responsibility|owner|ownership)\b|\b(approve|approval|approver|authorize)\b"
)
LIST_PATTERN = (
    r"\b(who are|what are|list|enumerate|name the|give me the list|sino sino|ano ano|ilista)\b"
)
ENRICH_RELATIONSHIP_PATTERN = (
    r"\b(relationship with|relationships with|romantic relationship|romantic relationships|love interest"
    r"|love interests|girlfriend|girlfriends|women|ladies|associated with|connected to)\b"
)
PERMISSION_PATTERN = (
    r"\b(allowed|allowable|permitted|permission|acceptable|okay|ok|pwede|puwede|bawal|prohibited|forbidden)\b"
)
PERMISSION_PEOPLE_PATTERN = (
    r"\b(who|which\s+(person|people|role|roles|team|teams|user|users|employee|employees|group|groups))\b"
    r"|\b(access|account|credential|role|roles|authorization|authorize|approver|approval\s+authority)\b"
)
PERMISSION_CODE_PATTERN = (
    r"\b(misra|coding|code|function|functions|parameter|parameters|argument|arguments|declaration|declarations"
    r"|switch|goto|label|labels|recursion|recursive|pointer|pointers|string|operator|operators|macro|macros|header"
    r"|library|stdarg|compiler|expression|expressions|array|arrays|return|loop|loops|struct|union|enum|typedef)\b"
)
TECHNICAL_KEYWORDS = (
    "policy standard procedure process workflow configuration setup install installation settings system network "
    "server database backup restore security access account password software hardware troubleshooting operation "
    "manual guideline requirement"
).split()
TOPIC_STOP_PHRASES = [
    "what can you tell me about", "tell me about", "give me an overview of", "overview of", "summary of", "explain",
    "describe", "what is", "who is", "who was", "ano ang tungkol kay", "ano ang tungkol sa", "ano ang",
    "tungkol kay", "tungkol sa", "ipaliwanag", "pakiexplain", "paki explain", "sino si", "sino ang", "please", "pls",
    "po", "ba",
]
IDENTITY_SUFFIXES = ["", " biography", " life", " known for", " background", " important facts"]
OVERVIEW_SUFFIXES = ["", " overview", " description", " summary", " background"]
ELIGIBILITY_SUBJECT_PATTERNS = [
    r"^(?:the\s+)?(?:approval|approver|approving)\s+(?:role|authority|entity|position|person)\s+"
    r"(?:(?:according\s+to|under|in|for|ayon\s+sa)\s+)?(.+)$",
    r"^(.+?)\s+(?:eligibility|entitlement|authorization|responsibility|approval)$",
    r"^(.+?)\s+(?:eligibility|entitlement|authorization|responsibility|approval)\s+.+$",
    r"^(?:eligibility|qualification)\s+for\s+(.+)$",
    r"^(?:eligible|qualified)\s+for\s+(.+)$",
    r"^entitlement\s+to\s+(.+)$",
    r"^entitled\s+to\s+(.+)$",
    r"^who\s+(?:is|are)\s+(?:eligible|qualified)\s+for\s+(.+)$",
    r"^who\s+(?:is|are)\s+entitled\s+to\s+(.+)$",
    r"^which\s+.+?\s+(?:is|are)\s+(?:eligible|qualified)\s+for\s+(.+)$",
    r"^who\s+(?:can|may)\s+(.+)$",
    r"^which\s+.+?\s+(?:can|may)\s+(.+)$",
    r"^who\s+(?:is|are)\s+(?:authorized|allowed|permitted)\s+to\s+(.+)$",
    r"^who\s+(?:is|are)\s+responsible\s+for\s+(.+)$",
    r"^which\s+.+?\s+(?:is|are)\s+responsible\s+for\s+(.+)$",
    r"^who\s+(?:can\s+)?(?:approve|authorize)\s+(.+)$",
    r"^which\s+.+?\s+(?:can\s+)?(?:approve|authorize)\s+(.+)$",
]
# term templates per eligibility intent; {} is the subject
ELIGIBILITY_TERMS = {
    "approval": ["{}", "{} approval", "approve {}", "{} approver", "authorized approver {}",
                 "{} approval authority"],
    "responsibility": ["{}", "{} responsibility", "responsible for {}", "{} owner", "{} assigned role",
                       "{} duties"],
    "authorization": ["{}", "{} authorization", "authorized to {}", "permission to {}", "permitted roles {}",
                      "{} access requirements", "{} allowed roles"],
    "entitlement": ["{}", "{} entitlement", "entitled to {}", "{} eligibility", "{} conditions",
                    "{} requirements"],
    "eligibility": ["{}", "{} eligibility", "eligible for {}", "{} qualification", "{} requirements",
                    "{} conditions", "{} criteria"],
}
ELIGIBILITY_INTENT_PATTERNS = [
    ("approval", r"\b(approve|approval|approver)\b"),
    ("responsibility", r"\b(responsible|responsibility|owner|ownership)\b"),
    ("authorization", r"\b(authorized|authorization|allowed|permission|permitted)\b|\b(who|which\s+.+?)\s+(can|may)\b"),
    ("entitlement", r"\b(entitled|entitlement)\b"),
]
PROCESS_KEYWORDS = ["procedure", "process", "steps", "workflow", "how to", "paano"]
PROCESS_TERMS = (
    "procedure process steps workflow sequence requirements responsibility approval verification".split()
)
POLICY_KEYWORDS = ["policy", "standard", "rule", "rules", "compliance"]
POLICY_TERMS = "policy standard rules requirements compliance scope exception responsibility".split()
CONFIGURATION_KEYWORDS = ["configure", "configuration", "setup", "install", "installation", "settings"]
CONFIGURATION_TERMS = (
    "configuration setup installation settings parameters requirements troubleshooting".split()
)
GENERAL_OVERVIEW_TERMS = [
    "definition", "overview", "description", "summary", "background", "purpose", "scope", "details",
    "important information",
]
CLAIM_AUXILIARIES = (
    "did|does|do|is|are|was|were|has|have|had|can|could|will|would|should|must"
)
NON_PERSON_TERMS = """
policy procedure standard standards manual guideline guidelines requirement requirements regulation regulations
document report agreement treaty law act code rule rules history war revolution occupation battle movement empire
government system software hardware network server database application platform framework protocol configuration
installation setup security backup process workflow architecture project program model method api company
organization organisation department division committee council university school institute association consortium
bank leave overtime benefit benefits misra
""".split()
NAME_PARTICLES = "de del dela la las los van von da di dos das bin al y".split()

# ---- Tagalog relation phrases, replaced in order -------------------------------------------
RELATION_PHRASES = [
    (r"\bnais\s+makamit\b", "goal"), (r"\bgustong?\s+makamit\b", "goal"),
    (r"\bmagbigay\s+ng\s+pahintulot\b", "approve"), (r"\bayon\s+sa\b", ""), (r"\bkailan\b", "when"),
    (r"\bpetsa\b", "date"), (r"\bnilagdaan\b", "signed"), (r"\bpagpirma\b", "signing"),
    (r"\bitinatag\b", "founded"), (r"\bnaitatag\b", "founded"), (r"\bpagkakatatag\b", "founding"),
    (r"\bnagtatag\b", "founder"), (r"\bnabuo\b", "formed"), (r"\bnagsimula\b", "started"),
    (r"\bnatapos\b", "ended"), (r"\binilabas\b", "issued"), (r"\bsino\b", "who"), (r"\bano\b", "what"),
    (r"\banong\b", "what"), (r"\bbakit\b", "why"), (r"\bpaano\b", "how"), (r"\bsaan\b", "where"),
    (r"\balin\b", "which"), (r"\bilang\b", "how many"), (r"\bgaano\b", "how much"), (r"\baraw\b", "days"),
    (r"\btaunang\b", "annual"), (r"\bpangunahing\b", "main"), (r"\blayunin\b", "purpose"),
    (r"\badhikain\b", "purpose"), (r"\bmithiin\b", "goal"), (r"\bhangarin\b", "goal"),
    (r"\bmahalaga\b", "important"), (r"\bkahalagahan\b", "importance"), (r"\bposisyon\b", "position"),
    (r"\bpamahalaan\b", "government"), (r"\bhinawakan\b", "held"), (r"\bteritoryo(?:ng)?\b", "territories"),
    (r"\bbinitiwan\b", "relinquished"), (r"\bisinuko\b", "ceded"), (r"\bdeklarasyon\b", "declaration"),
    (r"\bkalayaan\b", "independence"), (r"\bhunyo\b", "June"), (r"\bnauna\b", "before"),
    (r"\bpahintulot\b", "approval"), (r"\bmaaprubahan\b", "approved"), (r"\bdadaan\b", "requires"),
    (r"\b(?:ibinibigay|binibigay|ibinigay)\b", "provided"), (r"\b(?:ibigay|magbigay)\b", "provide"),
    (r"\b(?:nag[- ]?aapruba|nag[- ]?aapprove|umaapruba|umaapprove)\b", "approves"),
    (r"\b(?:inaaprubahan|inaprubahan)\b", "approved"), (r"\bapruba(?:han)?\b", "approve"),
    (r"\bpag-apruba\b", "approval"), (r"\bkailangan(?:g)?\b", "required"),
]
RELATION_PARTICLES = r"\b(?:ang|ng|mga|ay|ba|si|ni|kay|na|nang|sa)\b"

# ---- English test -----------------------------------------------------------------------------
ENGLISH_STARTERS = (
    "who what when where why how which is are was were do does did can could would should will tell explain "
    "describe define list name give show please"
).split()
TAGALOG_QUESTION_WORDS = "ano anong sino kailan saan bakit paano alin ilang gaano may".split()
TAGALOG_PHRASES = r"\b(ayon\s+sa|tungkol\s+sa|tungkol\s+kay|para\s+sa|mula\s+sa)\b"
TAGALOG_FUNCTION_WORDS = (
    "ang ng mga ay si ni kay para mula kung dahil ito iyan iyon siya niya nito din rin".split()
)
ENGLISH_FUNCTION_WORDS = (
    "the of and or for from with about into during before after through between against this that these those his "
    "her their its"
).split()
ENGLISH_DOCUMENT_TERMS = """
reference references issue issues standard standards section sections rule rules directive directives guideline
guidelines requirement requirements policy policies procedure procedures process processes system systems document
documents manual guide code compiler toolchain option options flag flags statement statements configuration setup
overview summary category classification example examples rationale purpose status eligibility approval portability
implementation undefined unspecified
""".split()

# ---- scope guards -------------------------------------------------------------------------------
OUTSIDE_INSTRUCTION = (
    r"\b(use|using|gamitin|gamit)\b.{0,40}\b(general|outside|external)\s+knowledge\b"
    r"|\b(outside\s+(the\s+)?(company\s+)?(knowledge|documents|kb)|from\s+the\s+(internet|web))\b"
)
MISSING_SCOPE = (
    r"\b(not\s+in|outside|wala\s+sa|hindi\s+nasa)\b.{0,55}"
    r"\b(company\s+documents?|company\s+knowledge|knowledge\s+base|kb|documents?)\b"
)
SCOPE_OVERRIDE = (
    r"\b(kahit|even\s+if|if\s+(it('s| is)?|that('s| is)?)\s+not)\b.{0,55}"
    r"\b(external\s+knowledge|general\s+knowledge|outside\s+knowledge)\b"
)
FRESHNESS = r"\b(latest|newest|current|today|this\s+year|most\s+recent)\b"
RELEASE_WORDS = r"\b(rule|directive|release|released|published|added|version|edition)\b"
CURRENT_ROLE = r"\bwho\s+is\s+(the\s+)?current\s+(president|prime\s+minister|king|queen)\b"

# ---- structured references -------------------------------------------------------------------------
SECTION_LIKE_KINDS = ["section", "article", "chapter", "part"]
RULE_REFERENCE = r"\b(rule|dir(?:ective)?)\s*(?:no\.?\s*|number\s*)?([0-9]+(?:\.[0-9]+)*[a-z]?)\b"
SECTION_REFERENCE = r"\b(section|article|chapter|part)\b\s*(?:no\.?\s*|number\s*)?([a-z0-9]+(?:\.[0-9]+)*)\b"
GROUPED_REFERENCE = (
    r"\b(rules?|directives?|dirs?)\s+([0-9]+(?:\.[0-9]+)*[a-z]?"
    r"(?:(?:\s*(?:,|and|&|or)\s*|\s+)[0-9]+(?:\.[0-9]+)*[a-z]?)+)"
)
MALFORMED_REFERENCE = r"\b(misra\s+)?(rule|directive|dir)\s+[a-z][a-z0-9_-]*\.[a-z0-9_.-]+\b"
VARIANT_REFERENCE = r"\b(?:rule|directive|dir|section|article|chapter|part)\s+[0-9]+(?:\.[0-9]+)*[a-z]?\b"
ANSWER_LIKE_VARIANT = r"^(yes|no|answer|the answer|according to|rule [0-9]+\.?[0-9]* states)\b"

# ---- numeric parameters ------------------------------------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.40, 0.60
RRF_K = 60
TOP_K, SOURCE_TOP_K, STRUCTURED_TOP_K, LIST_TOP_K, IDENTITY_TOP_K = 10, 80, 40, 60, 20
FINAL_TOP_K, COMPLETENESS_TOP_K = 3, 6
MIN_RETRIEVAL_SCORE, NEAR_THRESHOLD = 0.55, 0.49
COVERAGE_TOP_K, COVERAGE_MIN_SCORE = 12, 0.34
MAX_VARIANTS, MAX_VARIANT_CHARS = 2, 400
RESCORE_CHARS, PREVIEW_CHARS, TRACE_CHARS = 3000, 700, 240
CHUNK_SIZE, CHUNK_OVERLAP, MIN_DOCUMENT_CHARS = 900, 150, 50
