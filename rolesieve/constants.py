"""Values fixed by the domain: scales, sentinels, word lists and patterns."""

from __future__ import annotations

# Sentinels, notices and scales.
ALL_SCOPE = "__ALL__"
MASK_CHAR = "•"
MASK_PLACEHOLDER = "•" * 16
MASKED_VALUE_TEXT = "giá trị đã được ẩn theo chính sách"
EMPTY_TABLE_NOTICE = "[Bảng trong mục này không còn dữ liệu cụ thể sau khi lọc theo chính sách]"
RRF_K = 60
DISPLAY_ALPHA = 0.6
BM25_SIGMOID_SCALE = 5.0
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RERANK_ALPHA, RERANK_BETA, RERANK_LEVELS, MIN_RERANK_POOL = 0.8, 0.2, 5, 10

# Words that carry no retrieval signal.
STOPWORDS = [
    "là", "của", "và", "có", "được", "này", "đó", "các", "cho", "với",
    "tại", "về", "như", "từ", "trong", "khi", "để", "theo", "những",
    "một", "đã", "sẽ", "thì", "mà", "hay", "hoặc", "nên", "vì", "do",
    "bị", "bởi", "ra", "vào", "lên", "xuống", "đang", "rất", "cũng",
    "không", "còn", "nữa", "nào", "gì", "ai", "sao", "bao", "nhiêu",
    "thế", "ở", "đâu", "vậy", "à", "ư", "nhé", "nhỉ",
]

# Phrases of an answer that found nothing.
NO_ANSWER = ["không đủ nguồn", "không có đủ thông tin", "không tìm thấy", "không thể trả lời", "i don't have enough information", "i cannot answer", "not enough information"]

# Words of each question intent, in order of precedence.
INTENTS = {
    "export": ["xuất", "tải về", "tải xuống", "export", "download", "excel", "csv", "báo cáo xuất", "trích xuất toàn bộ"],
    "aggregate": ["tổng cộng", "tổng hợp", "bao nhiêu", "thống kê", "đếm", "trung bình", "sum", "count", "aggregate", "tổng số", "bao gồm tất cả"],
    "compare": ["so sánh", "khác nhau", "giống nhau", "phân biệt", "compare", "versus", "vs", "hơn hay kém", "khác biệt", "đối chiếu"],
    "summarize": ["tóm tắt", "tóm lược", "tổng quan", "overview", "summarize", "summary", "ngắn gọn", "điểm chính", "ý chính", "nội dung chính"],
}

# High-risk patterns of prompt injection, by category.
INJECTION = {
    "instruction_override": r"\b(ignore|disregard|forget|bypass|override)\b.{0,80}\b(previous|system|developer|all)\b.{0,40}\b(instruction|rule|policy)s?\b",
    "role_impersonation": r"\b(you are now|act as|pretend to be|jailbreak|dan mode|unrestricted mode)\b",
    "prompt_exfiltration": r"\b(reveal|show|print|dump|repeat|leak)\b.{0,80}\b(system prompt|developer message|hidden prompt|internal instruction)s?\b",
    "secret_exfiltration": r"\b(reveal|show|print|dump|export)\b.{0,80}\b(api key|password|token|secret|credential)s?\b",
    "markup_injection": r"(<\|im_start\|>|<\|im_end\|>|</?(system|developer|assistant|tool|instruction|prompt)>|\[\s*(system|developer|tool)\s*\])",
    "tool_abuse": r"\b(call|execute|run|invoke)\b.{0,80}\b(tool|function|shell|browser|url|http request)\b",
    "vietnamese_override": r"(bỏ qua|bỏ hết|quên|vượt qua|ghi đè).{0,80}(chỉ dẫn|hướng dẫn|quy tắc|chính sách)\b",
}

# Further injection patterns; the first hit blocks.
LOCAL_INJECTION = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"bỏ\s+qua\s+(tất\s+cả\s+)?hướng\s+dẫn",
    r"forget\s+(everything|your\s+instructions?)",
    r"you\s+are\s+now\s+(a\s+)?(?:evil|jailbreak|DAN|unrestricted)",
    r"act\s+as\s+(?:if\s+you\s+(?:have\s+no\s+restrictions?|are\s+jailbroken))",
    r"pretend\s+(you\s+are|to\s+be)\s+(?:an?\s+)?(?:evil|unrestricted|jailbroken)",
    r"dump\s+(all|every|the\s+entire)\s+(data|document|context|prompt|system)",
    r"print\s+(your\s+)?(system\s+)?prompt",
    r"liệt\s+kê\s+toàn\s+bộ\s+(tài\s+liệu|dữ\s+liệu|nội\s+dung)",
    r"show\s+me\s+(all|every)\s+(document|file|secret|hidden)",
    r"</?(system|prompt|instruction|context)>",
    r"\{\{.*?\}\}",
    r"<\|im_start\|>",
]

# Tags of the prompt that a text must not imitate.
SYSTEM_TAGS = ["user_question", "task_instructions", "retrieved_context", "conversation_history", "untrusted_retrieved_document", "untrusted_conversation_turn"]

# Question particles that a search leaves out.
QUESTION_TAIL = r"\s*(là gì|là ai|là bao nhiêu|như thế nào|thế nào|ra sao|ở đâu|khi nào|tại sao|vì sao)\s*\??\s*$"

# How a hidden value shows in an answer.
HIDDEN_VALUE = (
    r"(?:\[(?:PERSON_NAME|EMAIL_ADDRESS|PHONE_NUMBER|ADDRESS|SALARY_AMOUNT|BANK_ACCOUNT|TAX_ID|NATIONAL_ID|SOCIAL_INSURANCE|DOB|ĐÃ ẨN|ĐỐI TƯỢNG ĐÃ ẨN DANH|THÔNG TIN ĐÃ TÓM TẮT)[^\]]*\]"
    r"|giá trị\s+(?:này\s+)?(?:đã\s+)?được\s+ẩn|(?:nội dung|thông tin)\s+(?:này\s+)?đã\s+(?:được\s+)?ẩn|ẩn\s+theo\s+chính\s+sách)"
)
MASKED_MARKER = r"\[(?:[A-Z][A-Z0-9_]*)(?:\][A-Z]+)?\]?"
CITATION_LABEL = r"\[\s*(?:citation|cite|trích\s*dẫn|nguồn|nguon|source|ref|reference|context)\s*:?\s*\[?\s*([\d,\s]+?)\s*\]?\s*\]"

# Headings, page headers, and line ends after which no heading stops.
_UPPER = "A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ"
HEADING = (
    r"^(?:\s*(?:chương|phần|mục|section|chapter)\s+[\dIVXivx]+[.:]\s*.+|\s*(?:Điều|điều)\s+\d+[.:]\s*.+"
    rf"|\s*\d+[.)]\s+[{_UPPER}].{{3,80}}$|\s*[{_UPPER}]{{4,}}(?:\s+[{_UPPER}]+)*\s*$)"
)
PAGE_HEADER_LINE = r"^.{0,150}?(CÔNG TY TNHH [^|\n]{1,60}\|\s*Quy định|Mã tài liệu|Lần ban hành|Ngày hiệu lực).*$"
PAGE_HEADER = r"CÔNG TY TNHH|Mã tài liệu|Lần ban hành|Ngày hiệu lực"
CONNECTORS = [",", "và", "hoặc", "của", "theo", "để", "trong", "khi", "là", "các", "được", "có", "về", "với", "tại", "cho", "từ", "như", "này"]

# Patterns that place a text on the sensitivity scale.
SENSITIVITY = {
    4: [
        r"hồ\s+sơ\s+nhân\s+viên", r"\b[A-Z]{2,6}-EMP-\d+", r"mức\s+lương\s+cơ\s+bản", r"tổng\s+thu\s+nhập", r"lịch\s+sử\s+kỷ\s+luật", r"đánh\s+giá\s+nhân\s+viên", r"người\s+liên\s+hệ\s+khẩn\s+cấp",
        r"bảng\s+lương", r"thông\s+tin\s+tài\s+khoản\s+ngân\s+hàng", r"\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng)", r"số\s+cccd", r"địa\s+chỉ\s+thường\s+trú", r"chỗ\s+ở\s+hiện\s+tại",
    ],
    3: [
        r"doanh\s+thu\s+nội\s+bộ", r"ngân\s+sách\s+(?:bộ\s+phận|phòng|dự\s+án)", r"kế\s+hoạch\s+kinh\s+doanh", r"báo\s+cáo\s+tài\s+chính\s+nội\s+bộ", r"chiến\s+lược\s+(?:nội\s+bộ|công\s+ty)",
        r"kế\s+hoạch\s+nhân\s+sự", r"cắt\s+giảm\s+nhân\s+sự", r"danh\s+sách\s+(?:khách\s+hàng|đối\s+tác)",
    ],
    2: [r"nội\s+quy\s+(?:công\s+ty|lao\s+động)", r"quy\s+trình\s+nội\s+bộ", r"biên\s+bản\s+họp"],
}

# Typed entity patterns; the first group is the value where there is one.
ENTITY_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"\b0\d{2,3}[.\s]?\d{3}[.\s]?\d{3,4}\b",
    "national_id": r"(?i)(?:CCCD|CMND|Số CMND/CCCD|Số CMND|Số CCCD)[:\s/]*?(\d{9}|\d{12})",
    "tax_id": r"(?i)(?:mã số thuế)[^\d]{0,15}(\d{10,13})",
    "social_insurance": r"(?i)(?:số BHXH|số sổ BHXH)[:\s]*?([A-Z]{2}\d{8,12}|\d{8,12})",
    "bank_account": r"(?i)(?:tài khoản|TK)[^\d]{0,20}(\d{9,16})",
    "birth_date": r"(?i)(?:ngày sinh|sinh ngày|DOB)[:\s]*?(\d{1,2}/\d{1,2}/\d{2,4})",
    "percentage": r"\b\d{1,3}\s?%",
    "credential": r"(?i)\b(?:password|mật khẩu|api[_\s-]?key|token|secret|otp)\b\s*[:=]\s*[^\s,;]+",
}

# Flags of each entity label, and of words in the text.
ENTITY_FLAGS = {
    "email": ["has_pii"], "phone": ["has_pii"], "national_id": ["has_pii", "has_hr"], "tax_id": ["has_pii", "has_hr"], "social_insurance": ["has_pii", "has_hr"], "bank_account": ["has_pii", "has_financial"],
    "dob": ["has_pii", "has_hr"], "percentage": ["has_financial"], "date_generic": [], "credential": ["has_credential"], "person_name": ["has_pii"], "address": ["has_pii"], "salary": ["has_financial", "has_hr"],
    "money": ["has_financial"], "project": ["has_strategic"], "contract": ["has_legal"], "account_number": ["has_pii", "has_financial"],
}
FLAG_WORDS = {
    "has_credential": r"(mật khẩu|password|api[_\s]?key|token|secret|otp)",
    "has_legal": r"(nghị định|thông tư|điều\s+\d+|luật|hợp đồng|quyết định số)",
    "has_strategic": r"(chiến lược|kế hoạch mở rộng|sáp nhập|m&a|định hướng|roadmap)",
}
#: The same as whole words, in a form that both engines read alike.
FLAG_PATTERNS = {flag: rf"(?:^|[^\p{{L}}\p{{N}}_]){words}(?:$|[^\p{{L}}\p{{N}}_])" for flag, words in FLAG_WORDS.items()}

# Words by which a question names an entity label.
LABEL_ALIASES = {
    "salary": ["salary", "income", "wage", "pay", "lương", "thu nhập", "tiền công"],
    "person_name": ["name", "employee", "person", "tên", "nhân viên", "người"],
    "email": ["email", "mail", "e-mail", "thư điện tử"],
    "phone": ["phone", "mobile", "telephone", "số điện thoại", "điện thoại"],
    "address": ["address", "location", "địa chỉ", "nơi ở"],
    "money": ["money", "amount", "price", "cost", "tiền", "số tiền", "chi phí"],
}

# Keywords of secrets.
HARD_SECRETS = [
    "api key", "secret key", "private key", "mật khẩu hệ thống", "credentials nội bộ", "bảng lương", "danh sách sa thải", "danh sách nhân viên bị sa thải", "danh sách khách hàng vip",
    "kế hoạch mua lại", "kế hoạch sáp nhập", "lợi nhuận chưa công bố", "thỏa thuận bảo mật", "nda", "giá thỏa thuận riêng",
]
SOFT_SECRETS = [
    "doanh thu nội bộ", "ngân sách nội bộ", "chi phí nội bộ", "báo cáo tài chính nội bộ", "kế hoạch tài chính", "chiến lược nội bộ", "lộ trình sản phẩm", "roadmap nội bộ", "kế hoạch mở rộng",
    "kế hoạch kinh doanh bí mật", "thưởng nội bộ", "đánh giá nhân viên nội bộ", "cắt giảm nhân sự", "tranh chấp pháp lý", "đang bị kiện", "hợp đồng bảo mật", "non-disclosure", "thâu tóm", "m&a",
    "thông tin khách hàng bảo mật", "đối tác chiến lược bí mật", "source code nội bộ", "dự án bí mật", "dự án chưa ra mắt", "sản phẩm chưa công bố", "tính năng chưa phát hành",
]

# What a director does not see, and what stands for it.
DIRECTOR_REDACTIONS = [
    (r"\b\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng)\b", "[SỐ TIỀN ĐÃ ẨN]"),
    (r"\b(?:\+84|0)(?:3[2-9]|5[6-9]|7[0-9]|8[0-9]|9[0-9])[\s\-]?\d{3}[\s\-]?\d{3}\b", "[SĐT ĐÃ ẨN]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL ĐÃ ẨN]"),
    (r"\b\d{9}(?:\d{3})?\b", "[CCCD ĐÃ ẨN]"),
]

# Typed patterns of personal data with their scores, in order of precedence.
PII_PATTERNS = [
    ("PERSON_NAME", 0.8, r"\b(?:Nguyễn|Trần|Lê|Phạm|Hoàng|Huỳnh|Phan|Vũ|Võ|Đặng|Bùi|Đỗ|Hồ|Ngô|Dương|Lý)(?:\s+[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐƠƯ][a-zàáâãèéêìíòóôõùúýăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]+){1,3}\b"),
    ("PHONE_NUMBER", 0.85, r"\b(?:\+84|0)(?:3[2-9]|5[6-9]|7[0-9]|8[0-9]|9[0-9])[\s\-]?\d{3}[\s\-]?\d{3}\b"),
    ("SALARY_AMOUNT", 0.85, r"\b\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng|vnđ)\b"),
    ("ADDRESS", 0.75, r"(?:Số\s+\d+[^,\n]{0,30}(?:đường|phố|ngõ|ngách)[^,\n]{0,40}|(?:Căn hộ|Phòng)\s+\w+[^,\n]{0,60})"),
    ("CCCD_CMND", 0.7, r"\b\d{9}(?:\d{3})?\b"),
    ("EMAIL_ADDRESS", 0.9, r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("BANK_ACCOUNT", 0.5, r"\b\d{10,19}\b"),
    ("IP_ADDRESS", 0.8, r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("DATE_OF_BIRTH", 0.65, r"\b(?:0[1-9]|[12]\d|3[01])[/\-](?:0[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b"),
    ("PASSPORT", 0.6, r"\b[A-Z]\d{7,8}\b"),
]

# The rules a new store starts with: key, name, group, source of detection, action, sensitivity, flags.
DEFAULT_RULES = [
    ("credential", "Thông tin xác thực", "Bảo mật", "regex", "block", 5, ["has_credential"]),
    ("password", "Mật khẩu", "Bảo mật", "gliner", "block", 5, ["has_credential"]),
    ("api_key", "API key", "Bảo mật", "regex", "block", 5, ["has_credential"]),
    ("token", "Token", "Bảo mật", "regex", "block", 5, ["has_credential"]),
    ("salary", "Lương", "Nhân sự & Tài chính", "gliner", "mask", 4, ["has_financial", "has_hr"]),
    ("bonus", "Tiền thưởng", "Nhân sự & Tài chính", "gliner", "mask", 4, ["has_financial", "has_hr"]),
    ("income", "Thu nhập", "Nhân sự & Tài chính", "gliner", "mask", 4, ["has_financial", "has_hr"]),
    ("payroll", "Bảng lương", "Nhân sự & Tài chính", "gliner", "mask", 4, ["has_financial", "has_hr"]),
    ("bank_account", "Tài khoản ngân hàng", "Tài chính", "regex", "mask", 4, ["has_pii", "has_financial"]),
    ("tax_id", "Mã số thuế", "Tài chính", "regex", "mask", 4, ["has_pii", "has_financial"]),
    ("financial_data", "Dữ liệu tài chính", "Tài chính", "gliner", "mask", 4, ["has_financial"]),
    ("money", "Số tiền", "Tài chính", "regex", "mask", 3, ["has_financial"]),
    ("percentage", "Tỷ lệ", "Tài chính", "regex", "mask", 3, ["has_financial"]),
    ("customer", "Khách hàng", "Khách hàng", "gliner", "mask", 3, ["has_pii"]),
    ("customer_id", "Mã khách hàng", "Khách hàng", "gliner", "mask", 3, ["has_pii"]),
    ("customer_email", "Email khách hàng", "Khách hàng", "regex", "mask", 3, ["has_pii"]),
    ("customer_phone", "Điện thoại khách hàng", "Khách hàng", "regex", "mask", 3, ["has_pii"]),
    ("project", "Dự án", "Chiến lược", "gliner", "mask", 3, ["has_strategic"]),
    ("project_code", "Mã dự án", "Chiến lược", "gliner", "mask", 3, ["has_strategic"]),
    ("roadmap", "Lộ trình", "Chiến lược", "gliner", "mask", 4, ["has_strategic"]),
    ("strategy", "Chiến lược", "Chiến lược", "gliner", "mask", 4, ["has_strategic"]),
    ("business_plan", "Kế hoạch kinh doanh", "Chiến lược", "gliner", "mask", 4, ["has_strategic"]),
    ("merger", "Sáp nhập", "Chiến lược", "gliner", "block", 5, ["has_strategic"]),
    ("contract", "Hợp đồng", "Pháp lý", "gliner", "mask", 4, ["has_legal"]),
    ("contract_number", "Số hợp đồng", "Pháp lý", "gliner", "mask", 4, ["has_legal"]),
    ("person_name", "Họ tên", "Thông tin cá nhân", "gliner", "mask", 3, ["has_pii"]),
    ("national_id", "Số định danh", "Thông tin cá nhân", "regex", "mask", 4, ["has_pii", "has_hr"]),
    ("dob", "Ngày sinh", "Thông tin cá nhân", "regex", "mask", 4, ["has_pii", "has_hr"]),
    ("social_insurance", "Bảo hiểm xã hội", "Nhân sự & Tài chính", "regex", "mask", 4, ["has_pii", "has_hr"]),
    ("address", "Địa chỉ", "Thông tin cá nhân", "gliner", "mask", 3, ["has_pii"]),
    ("phone", "Số điện thoại", "Thông tin cá nhân", "regex", "mask", 3, ["has_pii"]),
    ("email", "Email", "Thông tin cá nhân", "regex", "mask", 3, ["has_pii"]),
    ("organization", "Tổ chức", "Chung", "gliner", "full", 1, []),
    ("date", "Ngày tháng", "Chung", "gliner", "full", 1, []),
    ("date_generic", "Ngày tháng dạng số", "Chung", "regex", "full", 1, []),
    ("location", "Địa điểm", "Chung", "gliner", "full", 1, []),
]

# Amounts of money, what is put after those without a unit so that a model takes them for money,
# and how many sets of labels a request may ask for one by one.
MONEY_SHAPE = r"\b[\d.,]+\s?(?:VND|đồng|VNĐ)\b|\b\d{1,3}(?:\.\d{3}){2,}\b"
MONEY_HINT = " $"
LABEL_SETS = 4

# Fixed values of the knowledge graph: document types, entity classes by sensitivity 1 to 5, classes and permission of
# each policy tier, static nodes (name, category, type) and static edges (from, relation, to).
DOCUMENT_TYPES = [
    "EmployeeProfile", "Contract", "FinancialReport", "TechnicalDocument", "MeetingMinutes", "Email", "Specification",
    "Policy", "ProjectPlan", "Invoice", "PurchaseOrder", "Proposal", "PerformanceReview", "TrainingMaterial",
    "Presentation", "AuditReport", "LegalDocument", "Memo", "Handbook", "Other",
]
ENTITY_CLASSES = ["PublicEntity", "InternalEntity", "ConfidentialEntity", "SecretEntity", "TopSecretEntity"]
TIER_NODES = {"allow": ("Allow", "AllowPolicy", "AllowEntity"), "mask": ("Mask", "MaskPolicy", "MaskEntity")}
STATIC_NODES = [
    ("Enterprise", "Organization", "Root"), ("Employee", "Employee", "Root"), ("Document", "Document", "Root"),
    *((x, "Document", "DocumentType") for x in DOCUMENT_TYPES),
    ("Entity", "Entity", "Root"), *((x, "Entity", "EntityClass") for x in ENTITY_CLASSES),
    ("AccessPolicy", "Policy", "Root"), ("AllowPolicy", "Policy", "PolicyClass"), ("MaskPolicy", "Policy", "PolicyClass"), ("AuditPolicy", "Policy", "PolicyClass"),
    ("Scope", "Scope", "Root"), ("RoleScope", "Scope", "ScopeClass"),
    ("Permission", "Permission", "Root"), ("AllowEntity", "Permission", "PermissionClass"), ("MaskEntity", "Permission", "PermissionClass"),
    ("ALLOW", "Decision", "Decision"), ("MASK", "Decision", "Decision"), ("BLOCK", "Decision", "Decision"), ("AUDIT", "Decision", "Decision"),
]
STATIC_EDGES = [
    *((x, "IS_A", "Document") for x in DOCUMENT_TYPES), *((x, "IS_A", "Entity") for x in ENTITY_CLASSES),
    ("AllowPolicy", "IS_A", "AccessPolicy"), ("MaskPolicy", "IS_A", "AccessPolicy"), ("AuditPolicy", "IS_A", "AccessPolicy"),
    ("RoleScope", "IS_A", "Scope"), ("AllowEntity", "IS_A", "Permission"), ("MaskEntity", "IS_A", "Permission"),
    ("Permission", "RESULTS_IN", "ALLOW"), ("Permission", "RESULTS_IN", "MASK"), ("Permission", "RESULTS_IN", "BLOCK"),
]

# Fixed values of conversations: statuses of answers that count, what stands before a summary, how many pairs a prompt gets.
DONE_STATUSES = ["success", "fallback", "no_answer", "llm_error", "blocked"]
SUMMARY_HEAD = "[Tóm tắt cuộc trò chuyện trước]\n"
RECENT_PAIRS, RELEVANT_PAIRS, HISTORY_MESSAGES, LISTED_MESSAGES = 3, 3, 200, 1000

# Fixed values of the rule migrations: level of a rule by its key (others: 2), and new names of groups.
DEFAULT_LEVELS = {
    "credential": 5, "password": 5, "api_key": 5, "token": 5, "merger": 5,
    "salary": 4, "bonus": 4, "income": 4, "payroll": 4, "social_insurance": 4, "national_id": 4, "dob": 4, "bank_account": 4, "tax_id": 4,
    "financial_data": 4, "contract": 4, "contract_number": 4, "strategy": 4, "business_plan": 4, "roadmap": 4,
    "money": 3, "percentage": 3, "customer": 3, "customer_id": 3, "customer_email": 3, "customer_phone": 3, "person_name": 3, "address": 3,
    "phone": 3, "email": 3, "project": 3, "project_code": 3,
    "organization": 1, "date": 1, "date_generic": 1, "location": 1,
}
OTHER_LEVEL = 2
GROUP_NAMES = {
    "security": "Bảo mật", "hr_financial": "Nhân sự & Tài chính", "financial": "Tài chính", "customer": "Khách hàng",
    "strategy": "Chiến lược", "legal": "Pháp lý", "pii": "Thông tin cá nhân", "general": "Chung",
}

# Provinces that end an address, and words one of which must stand before.
PROVINCES = (
    r"(?:Hà\s*Nội|TP\.?\s*Hồ\s*Chí\s*Minh|Thành\s*phố\s*Hồ\s*Chí\s*Minh|Hồ\s*Chí\s*Minh|TP\.?\s*HCM|TPHCM|"
    r"Hải\s*Phòng|Đà\s*Nẵng|Cần\s*Thơ|An\s*Giang|Bà\s*Rịa[\s\-]*Vũng\s*Tàu|Bạc\s*Liêu|Bắc\s*Giang|"
    r"Bắc\s*Kạn|Bắc\s*Ninh|Bến\s*Tre|Bình\s*Định|Bình\s*Dương|Bình\s*Phước|Bình\s*Thuận|"
    r"Cà\s*Mau|Cao\s*Bằng|Đắk\s*Lắk|Đắk\s*Nông|Điện\s*Biên|Đồng\s*Nai|Đồng\s*Tháp|Gia\s*Lai|"
    r"Hà\s*Giang|Hà\s*Nam|Hà\s*Tĩnh|Hải\s*Dương|Hậu\s*Giang|Hòa\s*Bình|Hưng\s*Yên|"
    r"Khánh\s*Hòa|Kiên\s*Giang|Kon\s*Tum|Lai\s*Châu|Lâm\s*Đồng|Lạng\s*Sơn|Lào\s*Cai|"
    r"Long\s*An|Nam\s*Định|Nghệ\s*An|Ninh\s*Bình|Ninh\s*Thuận|Phú\s*Thọ|Phú\s*Yên|"
    r"Quảng\s*Bình|Quảng\s*Nam|Quảng\s*Ngãi|Quảng\s*Ninh|Quảng\s*Trị|Sóc\s*Trăng|"
    r"Sơn\s*La|Tây\s*Ninh|Thái\s*Bình|Thái\s*Nguyên|Thanh\s*Hóa|Thừa\s*Thiên[\s\-]*Huế|"
    r"Tiền\s*Giang|Trà\s*Vinh|Tuyên\s*Quang|Vĩnh\s*Long|Vĩnh\s*Phúc|Yên\s*Bái)"
)
STREET_WORDS = (
    r"(?:Số\s*nhà|Số\s*\d|đường|phố|ngõ|hẻm|ngách|kiệt|thôn|xóm|ấp|tổ\s*\d|"
    r"khu\s*phố|căn\s*hộ|chung\s*cư|tòa\s*nhà|Phường|Xã|Thị\s*trấn|Quận|Huyện|Thị\s*xã)"
)
