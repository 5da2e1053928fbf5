"""Constants and word lists that results depend on."""

CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
LARGE_CHUNK_SIZE, LARGE_CHUNK_OVERLAP = 800, 120
EMBEDDING_DIM = 384
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
W_OVERLAP, W_COSINE, W_ORIGINAL, W_RANK = 0.55, 0.30, 0.10, 0.05
MMR_LAMBDA = 0.7
THRESHOLD, TOP_K, OVER_FETCH = 0.3, 5, 4
DOMAIN_BOOST = 0.25
SNIPPET = 2000
EVIDENCE_LIMIT, SENTENCE_MIN, SENTENCE_MAX = 4, 45, 420
PARAGRAPH_MIN = 30
SLUG_MAX = 80

#: Words that don't count when answers are matched.
ANSWER_STOPWORDS = ["và", "là", "của", "cho", "về", "ở", "vn", "việt", "nam", "theo", "các", "những", "gì", "nào", "như", "được", "quy", "định", "ma", "túy", "tuý"]
#: Words that don't count in the quality metrics.
METRIC_STOPWORDS = ["và", "là", "cho", "của", "để", "trong", "ngoại", "tại", "theo", "được", "có", "này", "với", "như", "các", "những", "bị", "về", "ra", "thì"]
#: Document type -> what in a question hints at it; the first type with a hint wins.
HINTS = {
    "legal": ["luật", "luat", "điều", "dieu", "nghị định", "nghi dinh", "hình phạt", "hinh phat", "bộ luật", "bo luat", "trách nhiệm hình sự", "trach nhiem hinh su", "cai nghiện", "cai nghien", "danh mục", "danh muc"],
    "news": ["nghệ sĩ", "nghe si", "ca sĩ", "ca si", "diễn viên", "dien vien", "rapper", "bị bắt", "bi bat", "tin tức", "tin tuc"],
}
#: Lines of a text that are no evidence, and how a sentence may begin in lower case.
EVIDENCE_MARKERS = ["title:", "source:", "original_path:", "người ký:", "công báo/số"]
LOWER_STARTS = ["luật này", "phòng", "chất", "người"]
#: What a question with an intent holds, one word of each list; "prohibited" and "prohibited_acts" count as one.
INTENTS = {
    "overview": [["luật", "luat"], ["phòng chống ma", "phòng, chống ma", "phong chong ma"]],
    "decree_summary": [["105"], ["nghị định", "nghi dinh"], ["tóm tắt", "tom tat", "nội dung", "noi dung", "quy định", "quy dinh"]],
    "penalty": [["hình phạt", "hinh phat", "phạt tù", "phat tu", "tội ", "toi "]],
    "prohibited": [["nghiêm cấm", "hành vi bị cấm"]],
    "prohibited_acts": [["hành vi"], ["ma túy"]],
    "storage": [["tàng trữ", "tang tru", "chất cấm", "chat cam", "tồn trữ", "bảo quản"]],
    "crime": [["tội", "toi ", "truy tố", "khởi tố", "hình phạt", "xử phạt", "bị án", "bị xử", "quy vào"]],
}
#: Names of the criminal code; words of storage; words of sentences that give a rule or a case; the article on prohibited acts.
CODE_EVIDENCE = ["bộ luật hình sự", "bo-luat-hinh-su", "điều 249"]
STORAGE_MENTIONS = ["tàng trữ", "tang tru"]
BASIS_WORDS = ["tàng trữ", "trái phép", "chất ma túy", "nghiêm cấm"]
CASE_WORDS = ["tàng trữ", "truy tố", "khởi tố", "ma túy", "heroin", "thu giữ"]
ARTICLE = "Điều 5"
#: Evidence for a legal question, for one about news, and for a question on the law's own text, by its source.
LEGAL_TERMS = ["luật", "luat", "hình phạt", "điều", "nghị định", "cai nghiện"]
NEWS_TERMS = ["nghệ sĩ", "ca sĩ", "diễn viên", "rapper", "bị bắt"]
LAW_SOURCE, LAW_TERMS = "luat-phong-chong-ma-tuy", ["phòng chống", "phòng, chống", "ma túy", "ma tuý"]
#: Lines with one of these, in any case, are page furniture.
NOISE = [
    "THƯ VIỆN PHÁP LUẬT", "Trang Thông tin điện tử tổng hợp", "loại rủi ro pháp lý", "nắm cơ hội làm giàu", "Các gói", "dịch vụ", "Chính sách Pháp", "luật mới", "Liên hệ", "Danh mục",
    "Văn bản và Tra cứu", "Tra cứu Pháp Luật mới", "Tra cứu Văn Bản trực tuyến", "Tra cứu Dự thảo", "Văn bản mới ban hành", "Tra cứu Tiêu Chuẩn", "Hỏi đáp pháp luật", "Đăng nhập", "Đăng ký",
    "Tài khoản", "Quên mật khẩu", "Gửi câu hỏi", "Văn bản liên quan", "Lược đồ", "Tải về", "In văn bản", "Bản dịch này thuộc quyền sở hữu", "has the copyright on this translation",
    "Mọi hành vi sao chép", "Copying or reposting",
]
#: Lines that end a legal text; words of its first lines.
END_MARKERS = ["Văn bản liên quan", "Lược đồ", "Thông tin văn bản", "Văn bản bị thay thế", "Văn bản được căn cứ", "Văn bản hướng dẫn", "Hỏi đáp pháp luật", "Tin tức pháp luật"]
GOVERNMENT, DECREE, FIRST_ARTICLE = ["chính phủ", "chinh phu"], ["nghị định", "nghi dinh"], ["điều 1", "dieu 1"]
LEGAL_MIN, NEWS_MIN, LOOK_AHEAD, SECTION_MIN, LEAD_LINES = 5000, 500, 180, 80, 5
#: The section on prohibited acts, the farthest that a section goes without an end, and how far after its start an end may begin.
ARTICLE_START, ARTICLE_ENDS, SECTION_MOST, SECTION_SKIP = "Điều 5. Các hành vi bị nghiêm cấm", ["Chương II", "Điều 6."], 6000, 10
#: What is searched for in place of a question about prohibited acts or storage, and what is added to one about a crime.
REWRITTEN = "Điều 5. Các hành vi bị nghiêm cấm Luật Phòng, chống ma túy tàng trữ trái phép chất ma túy tiền chất sản xuất vận chuyển mua bán tổ chức sử dụng trái phép chất ma túy"
ADDED = "tàng trữ trái phép chất ma túy truy tố khởi tố Luật Phòng chống ma túy Điều 5"
#: Facts of the two laws that have an overview, as (fact, pattern); the source that each is read from.
LAW_FACTS = [
    ("number", r"Luật số:\s*([0-9/]+QH[0-9]+)"),
    ("scope", r"(Luật này quy định về phòng, chống ma túy;.*?hợp tác quốc tế về phòng, chống ma túy\.)"),
    ("definition", r"(Phòng, chống ma túy là .*?liên quan đến ma túy\.)"),
    ("policy", r"(Thực hiện đồng bộ các biện pháp phòng, chống ma túy;.*?tệ nạn xã hội khác\.)"),
    ("education", r"(Tăng cường hoạt động tuyên truyền, giáo dục .*?phòng, chống ma túy\.)"),
]
DECREE_FACTS = [
    ("number", r"Số:\s*(105/2021/NĐ-CP)"),
    ("title", r"(NGHỊ ĐỊNH QUY ĐỊNH CHI TIẾT VÀ HƯỚNG DẪN THI HÀNH MỘT SỐ ĐIỀU CỦA LUẬT PHÒNG, CHỐNG MA TÚY)"),
    ("scope", r"(Nghị định này quy định chi tiết và hướng dẫn thi hành một số điều của Luật Phòng, chống ma túy .*?số 73/2021/QH14 ngày 30 tháng 3 năm 2021\.)"),
    ("subjects", r"(Nghị định này áp dụng đối với các cơ quan, tổ chức, cá nhân .*?quản lý người sử dụng trái phép chất ma túy\.)"),
    ("effect", r"(Nghị định này có hiệu lực thi hành kể từ ngày 01 tháng 01 năm 2022\.)"),
]
FACT_SOURCES = {"overview": "luat-phong-chong-ma-tuy-2021", "decree_summary": "nghi-dinh-105-2021-nd-cp"}
