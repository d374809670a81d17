"""Word lists, patterns, labels, limits and text formats.

Everything in this module is data that must have exactly these values for
results to be right; there is no logic here. Patterns are written in the
regular-expression dialect shared by Python and Java; flags are added where a
pattern is used (see ``text.rx``).
"""

# ---------------------------------------------------------------- FIXED VALUES
# Sizes and thresholds
CHUNK_SIZE = 4000
CHUNK_OVERLAP = 200
CHUNK_ID_PREFIX_CHARS = 100
CHUNK_ID_HEX = 16
NAME_SIMILARITY_THRESHOLD = 0.15
NAME_FUZZY_CAP = 0.95
NAME_EXACT_SCORE = 1.0
NAME_CONTAINS_SCORE = 0.8
COMPLETION_SCORE = 0.5
LEGAL_TOP_K = 5
VERDICT_TOP_K = 8
NAME_LIMIT = 20
HISTORY_MESSAGES = 5
HISTORY_ASSISTANT_CHARS = 500
SESSION_TITLE_CHARS = 30
SNIPPET_CHARS = 180
PREFIX_CAP = 180
PREFIX_DEPTH = 4
EVAL_KS = (1, 3, 5, 10, 20)
NULL_SHARE_LIMITS = (10.0, 30.0)

# Upper-case Vietnamese letters as used in headings
VN_UPPER = (
    "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
)

# ------------------------------------------------------------ statute documents
PAGE_LINE_PATTERNS = [
    r"^[-–—\s]*\d+[-–—\s]*$",
    r"^(Trang|Page|trang|page)\s*\d+$",
]
FORMAT_NOTE_PREFIX = "Formatted:"

# (all groups must hit, one needle of a group is enough) -> document type
FILE_NAME_TYPES = [
    ((("thong+tu", "thông+tư"), ("lien+tich", "liên+tịch")), "Thông tư liên tịch"),
    ((("thong+tu", "thông+tư"),), "Thông tư"),
    ((("nghi+dinh", "nghị+định", "nd-cp"),), "Nghị định"),
    ((("quyet+dinh", "quyết+định"),), "Quyết định"),
    ((("bo+luat", "bộ+luật"),), "Bộ luật"),
    ((("luat",),), "Luật"),
]
HEADER_TYPES = [
    ((("thông tư liên tịch",),), "Thông tư liên tịch"),
    ((("thông tư",),), "Thông tư"),
    ((("nghị định",),), "Nghị định"),
    ((("bộ luật",),), "Bộ luật"),
    ((("luật",),), "Luật"),
    ((("quyết định",),), "Quyết định"),
]
DEFAULT_DOC_TYPE = "Văn bản pháp luật"
TYPE_HEADER_CHARS = 500

DOC_NUMBER_PATTERNS = [
    r"(?:Luật|Nghị định|Thông tư|Quyết định|Bộ luật)\s*số[:\s]*(\d+[\/\-]\d+[\/\-][\w\-]+)",
    r"Số[:\s]*(\d+[\/\-]\d+[\/\-][\w\-]+)",
    r"số[:\s]*(\d+[\/\-]\d+[\/\-][\w\-]+)",
    r"(\d+\/\d{4}\/[\w\-]+)",
]
DOC_NUMBER_CHARS = 3000

DOC_NAME_TITLES = [
    ("Luật ", r"LUẬT\s*\n\s*([" + VN_UPPER + r"\s]+)"),
    ("Bộ luật ", r"BỘ LUẬT\s*\n\s*([" + VN_UPPER + r"\s]+)"),
]
DOC_NAME_CHARS = 2000
FILE_NUMBER_PREFIX = r"^\d+\.\d*\.?\s*"
TXT_SUFFIX = r"\.txt$"

AGENCIES = [
    (("QUỐC HỘI",), "Quốc hội"),
    (("CHÍNH PHỦ",), "Chính phủ"),
    (("BỘ KHOA HỌC VÀ CÔNG NGHỆ",), "Bộ Khoa học và Công nghệ"),
    (("BỘ TÀI CHÍNH",), "Bộ Tài chính"),
    (("BỘ NÔNG NGHIỆP",), "Bộ Nông nghiệp và Phát triển nông thôn"),
    (("BỘ VĂN HÓA", "BỘ VĂN HOÁ"), "Bộ Văn hóa, Thể thao và Du lịch"),
    (("BỘ CÔNG THƯƠNG",), "Bộ Công Thương"),
]
AGENCY_FALLBACK = r"(BỘ\s+[" + VN_UPPER + r"\s]+)"
AGENCY_CHARS = 1000

SIGNING_DATE_PATTERNS = [
    r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})",
    r"(\d{1,2})/(\d{1,2})/(\d{4})",
]
SIGNING_CHARS = 2000
#: Begins all three forms of the effective date.
EFFECTIVE_PHRASE = r"có\s+hiệu\s+lực"
EFFECTIVE_EXPLICIT = (
    r"có\s+hiệu\s+lực.*?(?:từ|kể từ)\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
)
EFFECTIVE_AT_SIGNING = r"có\s+hiệu\s+lực.*?kể\s+từ\s+ngày\s+ký"
EFFECTIVE_AFTER_DAYS = r"có\s+hiệu\s+lực.*?sau\s+(\d+)\s+ngày"

ARTICLE_AT_START = r"^(Điều\s+\d+[a-z]?)\.?\s*([^\n]*)"
ARTICLE_AMENDED = r"(\d+)\.\s*(Điều\s+\d+[a-z]?)\s+được\s+sửa\s+đổi"
ARTICLE_AMENDED_TITLE = "sửa đổi, bổ sung"
ARTICLE_QUOTED = r"""^["']?(Điều\s+\d+[a-z]?)\.?\s*([^"'\n]*)["']?"""
ARTICLE_ANYWHERE = r"(Điều\s+\d+[a-z]?)\.?\s*([^\n]{0,100})"
ARTICLE_TITLE_STOPS = ("của", "và")
ARTICLE_HEADING_STARTS = ("CHƯƠNG", "PHẦN", "MỤC", "QUỐC HỘI", "CHÍNH PHỦ", "BỘ ")
CONTINUED_TITLE = ("(tiếp theo ", ")")

HEADER_KEYWORDS = (
    "QUỐC HỘI",
    "CHÍNH PHỦ",
    "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "ĐỘC LẬP - TỰ DO - HẠNH PHÚC",
    "NƯỚC CỘNG HÒA",
)
APPENDIX_KEYWORDS = ("PHỤ LỤC", "BIỂU MẪU", "MẪU SỐ", "DANH MỤC")
SIGNATURE_PATTERNS = [
    r"(TM\.|T\.M\.|THAY MẶT)",
    r"(CHỦ TỊCH|BỘ TRƯỞNG|THỦ TƯỚNG)",
    r"(Nơi nhận|NƠI NHẬN)",
]
ARTICLE_MENTION = r"Điều\s+\d+"
CHUNK_TYPE_CHARS = 800

PART_PATTERN = r"(PHẦN THỨ\s+\w+)"
CHAPTER_PATTERNS = [
    r"(Chương\s+[IVXLC]+)[:\s]*\n\s*([" + VN_UPPER + r"\s,]+)",
    r"(CHƯƠNG\s+[IVXLC]+)[:\s]*\n\s*([" + VN_UPPER + r"\s,]+)",
    r"(Chương\s+\d+)[:\s]*\n\s*([^\n]+)",
]
SECTION_PATTERN = r"(Mục\s+\d+)"

STATUTE_SEPARATORS = [r"Điều \d", r"\n\n", r"\n", r"\. ", r" "]
STATUTE_SEPARATORS_PARITY = [r"Điều \d", r"\n\n", r"\n", r". ", r" "]
PLAIN_SEPARATORS = [r"\n\n", r"\n", r" ", r""]
VERDICT_SEPARATORS = [r"\n\n", r"\n", r"\. ", r" "]

# ------------------------------------------------------------------- verdicts
OCR_REPAIRS = [
    (r"(?m)^\s*(\d+(?:\.\d+)*)\s*(?=\s+[A-ZĐ])", "[$1]"),
    (r"\[(\d+(?:\.\d+)*)\s+(?=[A-ZĐa-zđ])", "[$1] "),
    (r"\[\s+(\d+(?:\.\d+)*)\]", "[$1]"),
    (r"[ \t]{3,}", "  "),
    (r"\n{4,}", "\n\n\n"),
]
CASE_NUMBER_PATTERNS = [
    r"Bản án số[:\s]*(\d+/\d{4}/[A-ZĐa-zđ\-]+)",
    r"BẢN ÁN SỐ[:\s]*(\d+/\d{4}/[A-ZĐa-zđ\-]+)",
]
CASE_FILE_NAME = r"^BA\s*(\d+)\s*-\s*(\d{4})"
COURT_PATTERNS = [
    r"(TÒA ÁN NHÂN DÂN\s+CẤP CAO\s+TẠI\s+[^\n]+)",
    r"(TOÀ ÁN NHÂN DÂN\s+CẤP CAO\s+TẠI\s+[^\n]+)",
    r"(TÒA ÁN NHÂN DÂN\s+[^\n]+)",
]
JUDGMENT_DATE_PATTERNS = [
    r"Ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})",
    r"Ngày[:\s]*(\d{1,2})\s*-\s*(\d{1,2})\s*-\s*(\d{4})",
    r"Ngày[:\s]*(\d{1,2})\s*[-/]\s*(\d{1,2})\s*[-/]\s*(\d{4})",
]
DISPUTE_PATTERNS = [
    r'V/v[.:\s]*["“]?([^\n"”]+)["”]?',
    r'về việc\s*["“]?([^\n"”]+)["”]?',
]
DISPUTE_CHARS = 2000
TRIAL_BY_NUMBER = [("PT", "phúc thẩm"), ("-ST", "sơ thẩm"), ("-GĐT", "giám đốc thẩm")]
TRIAL_BY_TEXT = ["phúc thẩm", "sơ thẩm"]
TRIAL_CHARS = 3000
PARTY_FIELDS = [
    ("plaintiff", r"[-–]?\s*Nguyên đơn\s*:\s*([^\n]+)"),
    ("defendant", r"[-–]?\s*Bị đơn\s*:\s*([^\n]+)"),
    ("third_party", r"[-–]?\s*Người có quyền lợi[^:]*:\s*([^\n]+)"),
]
PARTY_CHARS = 3000
PRESIDING_JUDGE = r"Chủ tọa phiên tòa\s*:\s*([^\n]+)"
OTHER_JUDGES = r"Các Thẩm phán\s*:\s*([^\n]+(?:\n[^\n]*(?:Ông|Bà)[^\n]*)*)"
JUDGE_NAME = r"(?:Ông|Bà)\s+([^;,\n]+)"
JUDGE_CHARS = 2000
RIGHT_TYPES = [
    ("nhãn hiệu", ("nhãn hiệu", "GCNĐKNH", "GCN ĐKNH", "đăng ký nhãn hiệu")),
    ("sáng chế", ("sáng chế", "Bằng độc quyền sáng chế", "patent")),
    ("quyền tác giả", ("quyền tác giả", "bản quyền tác phẩm", "bản quyền", "phần mềm máy tính")),
    ("kiểu dáng công nghiệp", ("kiểu dáng công nghiệp", "GCNĐKKDCN")),
    ("bí mật kinh doanh", ("bí mật kinh doanh", "bí mật thương mại")),
    ("tên thương mại", ("tên thương mại",)),
    ("chỉ dẫn địa lý", ("chỉ dẫn địa lý",)),
]
DEFAULT_RIGHT_TYPE = "sở hữu trí tuệ"
LAW_REFERENCE = (
    r"(?:điểm\s+\w+\s+)?(?:khoản\s+\d+\s+)?Điều\s+\d+[a-zđ]?"
    r"\s+(?:Luật|Bộ luật|Nghị định|Thông tư)[^,;\n]{5,60}"
)
LAW_REFERENCE_LETTERS = ("ề", "Ề")
LAW_REFERENCES_KEPT = 30
LAW_REFERENCES_JOINED = 20
SUMMARY_PARTS = {
    "case": "Bản án số ",
    "between": "giữa ",
    "and": " và ",
    "level": "cấp ",
    "court": "tại ",
}

FACTS_MARKER = r"NỘI DUNG VỤ ÁN\s*:"
REASONING_MARKER = r"NHẬN ĐỊNH CỦA TÒA ÁN\s*:"
DECISION_SENTINEL = r"Vì các lẽ trên"
DECISION_MARKER = r"QUYẾT ĐỊNH\s*:"
DECISION_LINE_MARKER = r"(?m)^\s*QUYẾT ĐỊNH\s*:"
DECISION_LOOKAHEAD_CHARS = 500

PARTY_PRESENTATIONS = [
    (r"(?:Nguyên đơn[^.]*?trình bày\s*:)", "nguyên đơn"),
    (r"(?:Bị đơn[^.]*?trình bày\s*:)", "bị đơn"),
    (r"(?:Người có quyền lợi[^.]*?trình bày\s*:)", "người có quyền lợi"),
    (r"(?:Người kháng cáo[^.]*?trình bày\s*:)", "người kháng cáo"),
    (r"(?:Viện [Kk]iểm sát[^.]*?(?:phát biểu|đề nghị)[^:]*:)", "viện kiểm sát"),
    (r"(?:(?:Vị )?[Đđ]ại diện Viện [Kk]iểm sát[^.]*?phát biểu[^:]*:)", "viện kiểm sát"),
    (r"(?:\*\s+(?:Yêu cầu|Theo đơn|Đại diện)[^\n]*:)", "trình bày"),
]
LOWER_COURT_MENTIONS = [
    r"Tại [Bb]ản án[^.]*sơ thẩm",
    r"Tại bản án kinh doanh[^.]*sơ thẩm",
]
LOWER_COURT_LABEL = "bản án sơ thẩm"
FACTS_LABEL = "nội dung"
FACTS_INTRO_CHARS = 50
POINT_MARKER = r"\[(\d+(?:\.\d+)*)\]"
INTRO_LABEL = "intro"
INTRO_CHARS = 30
ITEM_STYLES = [
    ("slash", r"(?m)^\s*(\d+)/\.", "%s/."),
    ("bracket", r"\[(\d+(?:\.\d+)*)\]", "[%s]"),
    ("roman", r"(?m)^\s*(I{1,3}|IV|VI{0,3}|IX|X{1,3})\.", "%s."),
    ("dot", r"(?m)^\s*(\d+)\.\s", "%s."),
]
ROMAN_STYLE_PARITY = r"(?m)^\s*(I{1,3}|IV|VI{0,3}|IX|X{0,3})\."
FEE_WORDS = r"(?:Án phí|án phí)"
FEE_IN_ITEM = r"[Áá]n phí"
FEE_ITEM_CHARS = 100
FEE_SPLIT_CHARS = 50
FEE_LABEL = "án phí"
DECISION_LABEL = "quyết định"
DECISION_INTRO_LABEL = "căn cứ"

SECTION_BOOSTS = [("reasoning", 1.3), ("decision_item", 1.1)]
KEY_SECTIONS = ("reasoning", "decision_item")
SECTION_RELATIONS = [
    ("fact", "CÓ_TÌNH_TIẾT"),
    ("lower_court_decision", "CÓ_TÌNH_TIẾT"),
    ("reasoning", "CÓ_NHẬN_ĐỊNH"),
    ("decision_item", "ĐÃ_TUYÊN_ÁN"),
    ("court_fee", "ĐÃ_TUYÊN_ÁN"),
]

# ------------------------------------------------------------ trademark records
SHEET_COLUMNS = [
    ("Brand name", "brand_name"),
    ("logo", "logo"),
    ("Status", "status"),
    ("inids.status_Date", "status_date"),
    ("IP office", "ip_office"),
    ("Owner", "owner_name"),
    ("Registration date", "registration_date"),
    ("Application number", "application_number"),
    ("general_words.registrationNumber", "registration_number"),
    ("Nice classification", "nice_classes"),
    ("Feature", "feature"),
    ("Application date", "application_date"),
    ("Expiry date", "expiry_date"),
    ("ST13", "st13"),
]
RECORD_START_LABEL = "Owner"
RECORD_LABELS = [
    ("Nice class", "nice_classes"),
    ("IPR", "ipr_type"),
    ("Country of filing", "country_of_filing"),
    ("Status", "status"),
    ("Number", "registration_number"),
]
RESULT_PAGE_CHROME = (
    "Results view", "Change layout", "Sort results", "Results per page",
    "Download results", "Filters", "Select all", "Statistics view",
    "List", "Grid", "Gallery",
)

# ------------------------------------------------------------- question routing
VERDICT_KEYWORDS = [
    r"tình huống", r"bồi thường", r"khởi kiện", r"kiện", r"phản tố",
    r"tòa\s*(án)?\s*(sẽ|đã|xử|xét)", r"bị đơn", r"nguyên đơn",
    r"bản án", r"án lệ", r"xâm phạm", r"vi phạm.*quyền",
    r"thiệt hại", r"bồi hoàn", r"xin lỗi.*công khai", r"đăng báo",
    r"công ty.*(?:tôi|chúng tôi)", r"tôi\s*(?:phát hiện|muốn|cần|nên)",
    r"nên\s*(?:làm|xử lý|kiện|khởi)", r"hướng giải quyết",
    r"phán quyết", r"nhận định", r"tranh chấp",
    r"sao chép", r"hàng nhái", r"hàng giả",
]
LEGAL_KEYWORDS = [
    r"(?:điều|khoản)\s*\d+", r"quy định", r"luật\s+(?:nào|gì|nói)",
    r"thủ tục", r"điều kiện\s*(?:đăng ký|cấp|bảo hộ)",
    r"thời hạn\s*(?:bảo hộ|đăng ký|khiếu nại)",
    r"nghị định", r"thông tư", r"hướng dẫn",
    r"đối tượng.*bảo hộ", r"quyền.*(?:tác giả|sáng chế|nhãn hiệu)",
    r"đăng ký.*(?:nhãn hiệu|sáng chế|kiểu dáng)",
    r"(?:mức|hình thức).*xử phạt", r"phân biệt.*(?:giữa|và)",
]
TRADEMARK_KEYWORDS = [
    r"tra\s*cứu.*nhãn\s*hiệu", r"nhãn\s*hiệu.*đã\s*đăng\s*ký",
    r"nhãn\s*hiệu.*tương\s*tự", r"xung\s*đột.*nhãn\s*hiệu",
    r"đăng\s*ký.*nhãn\s*hiệu.*(?:chưa|được\s*không|có\s*thể)",
    r"kiểm\s*tra.*nhãn\s*hiệu", r"trademark",
    r"tên\s*thương\s*(?:mại|hiệu).*(?:trùng|giống|tương\s*tự)",
    r"brand.*(?:search|lookup|check)",
    r"nhãn\s*hiệu.*(?:trùng|giống|xem|check|có\s*ai)",
    r"logo.*(?:đã\s*đăng\s*ký|trùng|giống)",
    r"thương\s*hiệu.*(?:đã\s*có|đã\s*đăng|trùng|xung\s*đột)",
]
ADVISORY_PATTERNS = [
    r"(?:tôi|chúng tôi)\s*(?:phát hiện|phát\s*hiện\s*ra).*(?:nên|cần|phải|làm)",
    r"(?:nên|cần|phải)\s*(?:làm\s*(?:gì|thế\s*nào|sao)|xử\s*lý\s*(?:thế\s*nào|ra\s*sao))",
    r"(?:bước|cách)\s*(?:xử\s*lý|giải\s*quyết|khiếu\s*nại|khởi\s*kiện)",
    r"(?:tôi|chúng tôi)\s*(?:bị|đã bị|đang bị).*(?:nên|cần|phải|làm)",
    r"(?:phát hiện|phát\shien).*(?:sử dụng|dùng|copy|sao chép|làm nhái|làm giả)",
    r"(?:xử\s*lý|giải\s*quyết|bảo\s*vệ).*(?:thế\s*nào|như\s*thế\s*nào|ra\s*sao)",
    r"(?:tôi|chúng tôi).*(?:logo|nhãn hiệu|thương hiệu|sáng chế|tác phẩm|thiết kế).*(?:bị|đang)",
    r"(?:bên khác|đối thủ|công ty khác|người khác).*(?:sử dụng|dùng|copy|sao chép|bắt chước)",
]

# ---------------------------------------------------------------- output texts
CONTEXT_SEPARATOR = "\n---\n"
CONTEXT_BEFORE_HEAD = "[Context trước]\n"
CONTEXT_AFTER_HEAD = "[Context sau]\n"
MISSING = "N/A"
STATUTE_BLOCK = (
    "\n=== NGUỒN {index} ===\n"
    "📄 {doc_name} | Số: {doc_number} | Loại: {doc_type}\n"
    "📍 {dieu} - {dieu_title}\n"
    "📅 Hiệu lực: {effective_date}\n"
    "\n{content}\n"
)
VERDICT_BLOCK = (
    "\n=== BẢN ÁN {index} ===\n"
    "Số: {case_number} | Tòa: {court_name} | Ngày: {judgment_date} | Cấp: {trial_level}\n"
    "Loại sở hữu trí tuệ: {ip_types}\n"
    "Nguyên đơn: {plaintiff} | Bị đơn: {defendant}\n"
    "Phần: {section_label}{section_detail}\n"
    "\n{content}\n"
)
SECTION_LABELS = [
    ("header", "Thông tin vụ án"),
    ("fact", "Tình tiết vụ án"),
    ("lower_court_decision", "Bản án sơ thẩm"),
    ("reasoning", "Nhận định pháp lý"),
    ("decision_item", "Phán quyết"),
    ("court_fee", "Án phí"),
]
SECTION_DETAILS = [
    ("point_number", " | Luận điểm "),
    ("party_role", " | "),
    ("item_number", " | Khoản "),
]
STATUTE_PROMPT = (
    "\nCÂU HỎI: {query}\n\nVĂN BẢN PHÁP LUẬT:\n{context}\n\n"
    "Trả lời tự nhiên, mượt mà như đang giải thích cho người bình thường."
    " Không dùng header cứng nhắc.\n"
)
VERDICT_PROMPT = (
    "\n[USER_CASE]: {query}\n\n"
    "[PRECEDENT_CONTEXT] (CHỈ các bản án sau đây được phép trích dẫn: {case_list}):\n{context}\n\n"
    "NHẮC LẠI: CHỈ trích dẫn các bản án có trong [PRECEDENT_CONTEXT] ở trên."
    " KHÔNG được nhắc đến bất kỳ bản án nào khác.\n"
    "Hãy phân tích và tư vấn cho người dùng theo cấu trúc IRAC."
    " Đối chiếu trực tiếp tình huống với các bản án, đưa ra hướng xử lý cụ thể.\n"
)
TRADEMARK_PROMPT = (
    "\nCÂU HỎI: Phân tích xung đột cho nhãn hiệu \"{query}\"\n\n"
    "KẾT QUẢ TRA CỨU TỪ CSDL NHÃN HIỆU ĐÃ ĐĂNG KÝ:\n{context}\n\n"
    "Hãy phân tích chi tiết mức độ xung đột và đưa ra khuyến nghị.\n"
)
COMBINED_PROMPT = (
    "\n{history}\nCÂU HỎI: {query}\n\n{context}\n\n"
    "NHẮC LẠI: CHỈ trích dẫn điều luật và bản án có trong dữ liệu trên."
    " KHÔNG nhắc đến bất kỳ nguồn nào khác.\n"
    "Hãy tư vấn toàn diện, kết hợp cả quy định pháp luật lẫn thực tiễn xét xử.\n"
)
COMBINED_STATUTE_HEAD = "[VĂN BẢN PHÁP LUẬT]:\n"
COMBINED_VERDICT_HEAD = "[BẢN ÁN THAM KHẢO] (CHỈ các bản án sau được phép trích dẫn: {case_list}):\n"
HISTORY_BLOCK = "\nLỊCH SỬ HỘI THOẠI (tham khảo để hiểu ngữ cảnh):\n{history}\n"
NO_STATUTE = "Xin lỗi, tôi không tìm thấy văn bản pháp luật nào liên quan đến câu hỏi của bạn."
NO_VERDICT = (
    "Xin lỗi, tôi không tìm thấy bản án nào liên quan đến tình huống "
    "của bạn trong cơ sở dữ liệu."
)
NO_TRADEMARK = "Không tìm thấy nhãn hiệu tương tự nào trong CSDL."
NO_COMBINED = (
    "Xin lỗi, tôi không tìm thấy dữ liệu liên quan trong cơ sở dữ liệu pháp luật và bản án."
)
NO_CASES = "không rõ"
TRADEMARK_LABELS = {
    "name": "Nhãn hiệu: ",
    "owner": "    Chủ sở hữu: ",
    "registration": "    Số đăng ký: ",
    "application": "    Số đơn: ",
    "st13": "    ST13: ",
    "classes": "    Nhóm Nice: ",
    "kind": "    Loại: ",
    "country": "    Nước đăng ký: ",
    "status": "    Trạng thái: ",
    "applied": "    Ngày nộp đơn: ",
    "registered": "    Ngày đăng ký: ",
    "expires": "    Ngày hết hạn: ",
    "score": "    Mức giống: ",
}
QUESTION_TEMPLATES = {
    "title_how": "{dieu_title} được quy định như thế nào?",
    "title_what": "Quy định về {dieu_title} là gì?",
    "article_in": "{dieu} trong {doc_name} quy định gì?",
    "article_of": "Nội dung của {dieu} thuộc {doc_name} là gì?",
    "article_number": "{dieu} của văn bản {doc_number} quy định gì?",
    "content": "Quy định sau nói về nội dung gì: {snippet}",
}
QUESTION_STYLE_WORDS = {
    "title": ("được quy định", "Quy định về"),
    "article": ("Điều", "điều"),
}
UNKNOWN_USER = "Unknown"
DEFAULT_SESSION_TITLE = "Đoạn chat mới"
# ------------------------------------------------------------ END FIXED VALUES
