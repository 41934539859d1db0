"""Keyword lists that sort documents into classes. Repeated words count twice."""

TYPE_WORDS = {
    "invoice": ["invoice", "bill", "tax", "total", "amount due", "subtotal", "invoice number", "invoice date",
                "due date", "payment terms", "item", "quantity", "price", "tax", "gst", "vat"],
    "bank_statement": ["account", "balance", "transaction", "debit", "credit", "statement", "bank", "deposit",
                       "withdrawal", "balance", "date", "description", "amount", "available balance"],
    "resume": ["resume", "cv", "curriculum vitae", "education", "experience", "skills", "objective", "summary",
               "qualification", "employment", "work history", "professional", "contact", "phone", "email"],
    "certificate": ["certificate", "certified", "this is to certify", "awarded", "completion", "achievement",
                    "issued", "date of issue", "certificate number", "valid", "authorized"],
    "id_card": ["id card", "identity", "identification", "card number", "date of birth", "dob", "address", "photo",
                "signature", "valid until", "issued by", "government"],
    "letter": ["dear", "sir", "madam", "yours sincerely", "yours faithfully", "regards", "subject", "reference",
               "date", "to", "from", "letter", "correspondence"],
    "office_document": ["memo", "memorandum", "report", "agenda", "minutes", "meeting", "department",
                        "organization", "company"],
    "bill": ["bill", "receipt", "payment", "charges", "fees", "service charge", "tax", "total amount"],
}
TABLE_BOOST = {"invoice": 2, "bank_statement": 2, "office_document": 1}

SHEET_WORDS = {
    "invoice": ["invoice", "invoice no", "invoice number", "invoice date", "billing address", "shipping address"],
    "bank_statement": ["bank statement", "account statement", "account summary", "statement period",
                       "opening balance", "closing balance", "bank name"],
    "bill_or_receipt": ["receipt", "bill", "payment receipt", "transaction receipt", "bill payment receipt",
                        "bill number", "receipt number", "paid amount", "payment method", "transaction id",
                        "biller name", "biller id", "b-connect txn id", "approval ref no", "consumer number",
                        "mobile number", "payment mode", "payment status", "payment channel", "bill date",
                        "bill amount", "total amount", "platform fee", "convenience fee", "spice money"],
    "resume": ["resume", "cv", "curriculum vitae", "education", "experience", "skills", "objective", "summary",
               "work history", "employment"],
    "certificate": ["certificate", "certified", "award", "achievement", "diploma", "degree", "issued",
                    "certification", "awarded"],
    "id_card": ["id card", "identity card", "identification", "photo id", "government id", "national id",
                "driving license", "license number"],
    "letter": ["dear", "sincerely", "yours", "regards", "letter", "to whom it may concern", "subject", "reference"],
    "generic_form": ["form", "application", "please fill", "signature", "date", "name", "address", "phone",
                     "registration number", "gst", "website url", "agent name", "agent id", "transaction date",
                     "total amount", "biller", "platform fee", "convenience fee", "bill amount", "bill date",
                     "payment channel", "payment status", "details", "field", "fill in"],
}

WORD_BLOCK_WORDS = {
    "bill_or_receipt": ["receipt", "bill", "payment receipt", "transaction receipt", "bill payment receipt",
                        "biller name", "biller id", "b-connect txn id", "approval ref no", "consumer number",
                        "mobile number", "payment mode", "payment status", "payment channel", "bill date",
                        "bill amount", "total amount", "platform fee", "convenience fee", "spice money"],
    "generic_form": ["form", "application", "please fill", "signature", "registration number", "gst",
                     "website url", "agent name", "agent id", "transaction date"],
    "certificate": ["certificate", "certified", "award", "achievement", "diploma", "degree", "issued",
                    "certification", "awarded"],
    "id_card": ["id card", "identity card", "identification", "photo id", "government id", "national id",
                "driving license", "license number", "date of birth"],
    "invoice": ["invoice", "invoice no", "invoice number", "invoice date", "billing address", "shipping address",
                "subtotal", "tax"],
    "bank_statement": ["bank statement", "account statement", "account summary", "statement period",
                       "opening balance", "closing balance", "bank name", "debit", "credit"],
}

CATEGORY_WORDS = {
    "invoice": ["invoice", "bill", "tax", "gst", "amount", "total", "subtotal", "due date", "invoice number",
                "invoice no", "bill to", "ship to"],
    "bank_statement": ["bank", "statement", "account", "balance", "transaction", "credit", "debit", "deposit",
                       "withdrawal", "cheque"],
    "govt_form": ["आवेदन", "फॉर्म", "प्रमाणपत्र", "अनुमति", "लाइसेंस", "रजिस्ट्रेशन", "प्रमाण", "दस्तावेज"],
    "academic": ["university", "college", "degree", "course", "grade", "semester", "credits", "transcript", "marksheet"],
    "resume": ["resume", "cv", "curriculum vitae", "experience", "education", "skills", "objective", "summary"],
}

ID_CARD_WORDS = ["name", "dob", "date of birth", "id no", "aadhaar", "pan", "passport", "license", "uid", "gender",
                 "nationality", "address", "father", "mother", "issued", "valid", "expiry", "photo", "signature",
                 "issuing authority", "document number"]
ID_LAYOUT_WORDS = ["name", "id", "dob", "date of birth", "address", "photo", "signature"]
PLACEHOLDER_WORDS = ["enter", "type here", "click to", "placeholder", "sample text", "lorem ipsum", "example",
                     "template", "form", "fill in"]

# Type by file name, then by the first class with a word in the text, then two finance words.
NAME_TYPES = [("bill", "bill"), ("receipt", "receipt"), ("invoice", "invoice")]
FIRST_WORD_TYPES = [
    (["bill payment", "biller", "payment receipt", "transaction", "spice money"], "bill"),
    (["receipt", "payment received"], "receipt"), (["invoice", "invoice number"], "invoice"),
]
FINANCE_WORDS = ["payment", "amount", "total", "transaction date"]

APPLICATION_WORDS = ["application", "staff selection commission", "registration no", "candidate",
                     "application completed", "constable", "ssc"]
APPLICATION_TEXTS = ["staff selection commission", "application completed", "registration no:"]
GOVERNMENT_WORDS = ["government", "ministry", "department", "commission", "board"]
TWO_COLUMN_NAMES = ["resume", "spice", "spicemoney", "pan link", "panlink", "fee rcpt", "fee receipt"]
TWO_COLUMN_TEXTS = ["spice money", "spicemoney", "b-connect", "pan link", "income tax department", "fee receipt",
                    "enrollment no", "resume"]

CHECKBOX_MARKS = ["✓", "☑", "×", "☐", "checked", "unchecked", "yes", "no", "true", "false"]
CHECKED = ["✓", "☑", "checked", "yes", "true"]
RADIO_MARKS = ["○", "●", "selected", "unselected"]
SELECTED = ["●", "selected"]
