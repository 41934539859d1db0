"""Keyword volumes, suggestion rules, index word lists and page names."""

# Estimated monthly searches of each phrase.
KEYWORD_VOLUMES = {
    "pdf converter": 450000, "jpg to pdf": 165000, "word to pdf": 135000, "pdf to word": 110000,
    "merge pdf": 90000, "split pdf": 74000, "compress pdf": 60500, "edit pdf": 49500,
    "pdf to jpg": 49500, "pdf to excel": 40500, "excel to pdf": 33100, "pdf to ppt": 27100,
    "ppt to pdf": 22200, "protect pdf": 18100, "unlock pdf": 14800, "watermark pdf": 12100,
    "crop pdf": 9900, "add page numbers pdf": 8100,
    "remove background": 135000, "image converter": 49500, "resize image": 33100,
    "compress image": 27100, "image editor": 22200, "image repair": 18100,
    "watermark image": 14800, "ocr image": 12100, "image to text": 9900,
    "resume maker": 110000, "resume builder": 90500, "cv maker": 49500, "online resume": 33100,
    "resume generator": 27100, "biodata maker": 14800,
    "zip converter": 18100, "rar extractor": 12100, "7z extractor": 8100,
    "ai image generator": 22200, "background remover": 135000,
}
KEYWORD_STOP_WORDS = ["online", "free", "tool", "convert", "converter", "the", "a", "an"]
VOLUME_DEFAULTS = [
    (["pdf", "convert", "merge", "split"], 5000), (["image", "photo", "picture"], 3000),
    (["resume", "cv", "biodata"], 2000),
]
OTHER_VOLUME = 500
PARTIAL_SHARE = 0.3

# Suggestion groups. A group applies when one of its words occurs in the heading; in it
# the first branch applies whose words all have one alternative in the heading.
SUGGESTION_GROUPS = [
    (["pdf"], [
        ([["merge", "combine"]], [("merge pdf online free", 90000), ("combine pdf files", 49500)]),
        ([["split"]], [("split pdf online free", 74000), ("divide pdf", 18100)]),
        ([["compress"]], [("compress pdf online free", 60500), ("reduce pdf size", 33100)]),
        ([["edit"]], [("edit pdf online free", 49500), ("pdf editor online", 33100)]),
        ([["protect", "password"]], [("password protect pdf", 18100), ("secure pdf", 12100)]),
        ([["unlock", "remove password"]], [("unlock pdf online free", 14800), ("remove pdf password", 12100)]),
        ([["watermark"]], [("add watermark to pdf", 12100), ("pdf watermark", 9900)]),
        ([["crop"]], [("crop pdf pages", 9900), ("pdf cropper", 8100)]),
        ([["page numbers"]], [("add page numbers to pdf", 8100), ("number pdf pages", 6600)]),
    ]),
    (["image", "photo"], [
        ([["background"], ["remove"]], [("remove background from image", 135000), ("background remover online", 90500)]),
        ([["resize"]], [("resize image online free", 33100), ("image resizer", 22200)]),
        ([["compress"]], [("compress image online free", 27100), ("image compressor", 18100)]),
        ([["edit"]], [("edit image online free", 22200), ("online image editor", 14800)]),
        ([["repair", "fix"]], [("repair damaged image", 18100), ("fix corrupted image", 12100)]),
        ([["watermark"]], [("add watermark to image", 14800), ("image watermark", 12100)]),
        ([["ocr", "text"]], [("ocr image to text", 12100), ("image to text converter", 9900)]),
    ]),
    (["resume", "cv", "biodata"], [
        ([[""]], [("resume maker online free", 110000), ("resume builder", 90500),
                  ("online resume creator", 33100), ("free resume generator", 27100)]),
    ]),
    (["to pdf"], [
        ([["jpg", "image"]], [("jpg to pdf converter", 165000), ("image to pdf", 90500)]),
        ([["word", "doc"]], [("word to pdf converter", 135000), ("doc to pdf", 90500)]),
        ([["excel", "xls"]], [("excel to pdf converter", 33100), ("xls to pdf", 22200)]),
        ([["ppt", "powerpoint"]], [("ppt to pdf converter", 22200), ("powerpoint to pdf", 18100)]),
    ]),
    (["pdf to"], [
        ([["word", "doc"]], [("pdf to word converter", 110000), ("pdf to doc", 90500)]),
        ([["jpg", "image"]], [("pdf to jpg converter", 49500), ("pdf to image", 33100)]),
        ([["excel", "xls"]], [("pdf to excel converter", 40500), ("pdf to xls", 27100)]),
        ([["ppt", "powerpoint"]], [("pdf to ppt converter", 27100), ("pdf to powerpoint", 22200)]),
    ]),
]

# Extra index keywords by words of the page name.
NAME_KEYWORDS = [
    (["pdf"], ["pdf", "document"]), (["image", "jpg", "png"], ["image", "photo", "picture"]),
    (["convert", "to"], ["convert"]), (["merge"], ["combine", "join"]), (["split"], ["divide", "separate"]),
    (["compress"], ["reduce", "shrink", "optimize"]), (["protect"], ["password", "secure", "lock"]),
    (["unlock"], ["remove password", "decrypt", "open"]), (["edit"], ["modify", "change"]),
    (["crop"], ["trim", "cut"]), (["watermark"], ["logo", "mark", "stamp"]),
    (["resize"], ["scale", "dimension", "size"]), (["remove", "remover"], ["delete"]),
    (["extract", "extractor"], ["unzip", "open", "extract"]), (["zip"], ["archive", "compressed"]),
    (["rar"], ["archive"]), (["ocr"], ["text", "recognition", "read"]),
    (["ai"], ["artificial intelligence", "generate", "create"]), (["resume"], ["cv", "biodata", "job"]),
    (["biodata"], ["marriage", "personal", "bio"]), (["marriage"], ["wedding", "card", "invitation"]),
]

# Category by the first group with a word in the page name.
CATEGORY_WORDS = [
    (["pdf"], "PDF Tools"),
    (["jpg", "png", "webp", "image", "photo", "bmp", "tiff", "svg", "ico", "heic", "cr2", "raw", "psd", "hdr",
      "avif", "eps", "ai"], "Image Tools"),
    (["excel", "word", "ppt", "powerpoint", "office"], "Office Tools"),
    (["epub", "mobi", "azw3", "fb2", "txt", "rtf", "text"], "E-book Tools"),
    (["zip", "rar", "7z", "tar", "iso", "folder", "archive", "extract"], "Archive Tools"),
    (["ocr", "background", "remove", "enhance", "repair", "cropper"], "Image Tools"),
    (["resume", "biodata", "marriage", "card"], "Document Tools"),
]
OTHER_CATEGORY = "Other Tools"

# Descriptions; every listed group of alternatives must occur in the page name.
DESCRIPTIONS = [
    ([["pdf"], ["merge"]], "Combine multiple PDF files into one document"),
    ([["pdf"], ["split"]], "Split PDF file into multiple documents"),
    ([["pdf"], ["compress"]], "Reduce PDF file size without losing quality"),
    ([["pdf"], ["protect"]], "Add password protection to PDF files"),
    ([["pdf"], ["unlock"]], "Remove password protection from PDF files"),
    ([["pdf"], ["edit"]], "Edit PDF documents online"),
    ([["pdf"], ["crop"]], "Crop PDF pages to remove unwanted areas"),
    ([["pdf"], ["watermark"]], "Add watermark to PDF documents"),
    ([["pdf"], ["page"], ["number"]], "Add page numbers to PDF documents"),
    ([["image", "jpg", "png"], ["compress"]], "Compress images to reduce file size"),
    ([["image", "jpg", "png"], ["resize"]], "Resize images to change dimensions"),
    ([["image", "jpg", "png"], ["edit"]], "Edit images online with professional tools"),
    ([["image", "jpg", "png"], ["watermark"]], "Add watermark to images"),
    ([["image", "jpg", "png"], ["crop"]], "Crop images to remove unwanted areas"),
    ([["image", "jpg", "png"], ["repair"]], "Repair and restore damaged images"),
    ([["image", "jpg", "png"], ["enhance"]], "Enhance image quality and appearance"),
    ([["image", "jpg", "png"], ["background", "remover"]], "Remove background from images automatically"),
    ([["image", "jpg", "png"], ["transparent"]], "Create transparent background images"),
    ([["image", "jpg", "png"], ["exif"]], "Remove EXIF data from images"),
    ([["ocr"]], "Extract text from images using OCR technology"),
    ([["ai"], ["image"]], "Generate images using AI technology"),
    ([["resume"]], "Create professional resume online"),
    ([["biodata"]], "Create marriage biodata form online"),
    ([["marriage"], ["card"]], "Create marriage invitation card online"),
]

# Pages that the index leaves out, by name, by ending and by beginning.
EXCLUDED_PAGES = [
    "index.html", "search.html", "result.html", "test-backend-connection.html",
    "get-mongodb-connection.html", "feedback.html", "accounts.html", "about.html",
    "contact.html", "disclaimer.html", "dmca.html", "attributions.html",
    "kyc-support.html", "payment-method.html", "payment-receipt.html",
    "shipping-billing.html", "pricing.html", "refund-policy.html",
    "terms-of-service.html", "privacy-policy.html", "dashboard.html",
    "login.html", "signup.html", "blog.html", "pdf-editor-preview.html",
    "background-workspace.html", "background-style.html", "image-editor-result.html",
    "image-resizer-result.html", "Indian-style-Resume-print.html",
    "generate-bg-removal-animations.html", "image-repair-editor.html",
    "pdf-to-excel-faq.html", "pdf-to-excel-convert.html", "pdf-to-word-converter.html",
]
EXCLUDED_ENDING, EXCLUDED_BEGINNING = "-convert.html", "blog-"
SKIPPED_FOLDERS = [
    "node_modules", "backup", "backups", "server", "api", "frontend", "services", "tools", "scripts",
    "css", "js", "images",
]
FEEDBACK_MARKS = ["Reviews &amp; Comments", "Reviews & Comments", "feedback-section", "Share Feedback"]
