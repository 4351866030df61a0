"""Words that requests, titles and answers are made of."""

# They must equal those of the listings and answers that this engine stands in for.

QUARTER, HALF, ANNUAL, LATEST = "Quý", "6 tháng", "Cả năm", "Mới nhất"
PERIODS = (QUARTER, HALF, ANNUAL, LATEST)

CONSOLIDATED, PARENT = "Hợp nhất", "Công ty mẹ"
STATUSES = (CONSOLIDATED, PARENT)

# a title that contains the word, in lower case, is of the period; the first that holds counts
PERIOD_WORDS = (("kiểm toán", ANNUAL), ("soát xét", HALF), ("quý", QUARTER))
STATUS_WORDS = (("hợp nhất", CONSOLIDATED),)

LINK_HOST = "https://finance.vietstock.vn"
LISTING_PATH = "/tai-tai-lieu.htm?doctype=1"

TITLE_STAMP = r"\s*\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}\s*$"

TODAY = "'Hôm nay là ngày' dd 'tháng' MM 'năm' yyyy"

SKIPPED = "Một số báo cáo bạn yêu cầu chưa đến kỳ phát hành và đã được bỏ qua:\n"
NOTHING_ASKED = "Tôi nhận thấy yêu cầu của bạn dành cho một báo cáo trong tương lai và chưa được phát hành. Do đó, không có tác vụ tìm kiếm nào được thực hiện."
BROKEN_QUERY = "Lỗi nghiêm trọng khi xử lý query: {detail}"
NO_PENDING = "Không có yêu cầu nào đang chờ."
NO_PROMPT = "Lỗi logic: Thiếu prompt hoặc lựa chọn để hỏi người dùng."

EMPTY_LISTING = "Không tìm thấy báo cáo nào cho mã {code} năm {year}."
UNKNOWN_CODE = "Không tìm thấy thông tin cho mã chứng khoán '{code}'. Vui lòng kiểm tra lại mã."
BROKEN_LISTING = "Lỗi khi scraping web: {detail}"

LATEST_OF_STATUS = "Đã tìm thấy báo cáo mới nhất theo yêu cầu: '{title}'."
NO_LATEST_OF_STATUS = "Không tìm thấy báo cáo '{status}' mới nhất cho mã {code}."
LATEST_OF_ALL = "Đã tìm thấy báo cáo mới nhất: '{title}'. (Mặc định lấy báo cáo đầu tiên trong danh sách)."
EXACT = "Đã tìm thấy báo cáo '{title}' theo yêu cầu."
NO_EXACT = "Không tìm thấy báo cáo '{asked} - {status}' bạn yêu cầu."
NO_QUARTER = "Không tìm thấy báo cáo Quý {quarter} và các quý trước đó cho năm {year}."
NO_CHOICE = "Không tìm thấy báo cáo tài chính nào phù hợp cho năm {year}."
ONLY_CHOICE = "Chỉ tìm thấy một báo cáo phù hợp duy nhất: '{title}'. Hệ thống sẽ tự động xử lý."
QUARTER_MISSING = "Không tìm thấy báo cáo Quý {quarter}. "
CHOICES = "Tôi đã tìm thấy các báo cáo sau cho {code} năm {year}:\n"
EARLIER_CHOICES = "Không tìm thấy báo cáo cho Quý {quarter} Năm {year}. \nTuy nhiên, tôi đã tìm thấy các báo cáo gần nhất sau:\n"
WHICH = "Bạn muốn tôi phân tích báo cáo nào?"

FAILED = "LỖI: {error}"
FAILED_MARK = "LỖI"
NEITHER = "LỖI: Không có link hoặc thông báo lỗi được trả về."

STATE_ONLY = "Mục tiêu: {context}\n\nTrạng thái:\n{note}"
APOLOGY = "Rất tiếc, tôi không thể xử lý yêu cầu của bạn. Vui lòng thử lại với một truy vấn khác."
AIM = "Mục tiêu phân tích: {context}"
NOTE = "\nThông báo:\n{note}"
RESULTS = "\nKết quả tìm kiếm:"
FAILURE_LINE = "Yêu cầu {id}: Thất bại. {result}"
SUCCESS_LINE = "Yêu cầu {id}: Thành công. Link: {result}"
