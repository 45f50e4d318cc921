"""Document categories and the fields that each expects."""

#: Categories (fixed values).
CATEGORIES = (
    "GOVERNMENT_NOTICE", "INVOICE", "RECEIPT", "CERTIFICATE", "COLLEGE_DOCUMENT", "BANK_DOCUMENT", "LEGAL_DOCUMENT", "EMPLOYMENT_DOCUMENT", "FORM", "LETTER",
    "IDENTITY_DOCUMENT", "MEDICAL_DOCUMENT", "INSURANCE_DOCUMENT", "TAX_DOCUMENT", "RESUME", "PASSPORT", "UTILITY_BILL", "PROPERTY_DOCUMENT", "TRANSPORT_DOCUMENT",
    "FINANCIAL_REPORT", "UNKNOWN",
)
#: Expected fields and their types by category; any other category takes those of UNKNOWN (fixed values).
EXPECTED_FIELDS = {
    "GOVERNMENT_NOTICE": {"title": "TEXT", "issuing_authority": "NAME", "issue_date": "DATE", "deadline": "DATE", "reference_number": "ID_NUMBER", "subject": "TEXT", "eligibility": "TEXT", "contact_info": "TEXT"},
    "INVOICE": {"invoice_number": "ID_NUMBER", "invoice_date": "DATE", "vendor_name": "NAME", "vendor_gstin": "ID_NUMBER", "buyer_name": "NAME", "buyer_gstin": "ID_NUMBER", "subtotal": "CURRENCY", "tax_amount": "CURRENCY", "total_amount": "CURRENCY", "payment_due_date": "DATE", "items": "LIST"},
    "RECEIPT": {"merchant": "NAME", "date": "DATE", "total_amount": "CURRENCY", "payment_method": "TEXT", "receipt_number": "ID_NUMBER", "items": "LIST"},
    "CERTIFICATE": {"holder_name": "NAME", "cert_type": "TEXT", "cert_number": "ID_NUMBER", "issue_date": "DATE", "expiry_date": "DATE", "issuing_authority": "NAME", "course_or_achievement": "TEXT"},
    "COLLEGE_DOCUMENT": {"institution": "NAME", "student_name": "NAME", "roll_number": "ID_NUMBER", "document_type": "TEXT", "academic_year": "TEXT", "programme": "TEXT", "marks_or_grades": "TEXT", "date": "DATE"},
    "BANK_DOCUMENT": {"account_holder": "NAME", "account_number": "ID_NUMBER", "bank_name": "NAME", "ifsc_code": "ID_NUMBER", "branch": "TEXT", "statement_period": "TEXT", "opening_balance": "CURRENCY", "closing_balance": "CURRENCY"},
    "LEGAL_DOCUMENT": {"parties": "LIST", "court": "NAME", "case_number": "ID_NUMBER", "date": "DATE", "subject": "TEXT", "jurisdiction": "TEXT", "summary": "TEXT"},
    "EMPLOYMENT_DOCUMENT": {"employee_name": "NAME", "employer_name": "NAME", "designation": "TEXT", "date": "DATE", "joining_date": "DATE", "ctc": "CURRENCY", "document_type": "TEXT"},
    "FORM": {"form_name": "TEXT", "form_number": "ID_NUMBER", "date": "DATE", "applicant_name": "NAME", "key_fields": "LIST", "submission_office": "TEXT"},
    "LETTER": {"sender": "NAME", "recipient": "NAME", "date": "DATE", "subject": "TEXT", "reference": "ID_NUMBER", "summary": "TEXT"},
    "IDENTITY_DOCUMENT": {"full_name": "NAME", "id_number": "ID_NUMBER", "date_of_birth": "DATE", "gender": "TEXT", "address": "ADDRESS", "issue_date": "DATE", "expiry_date": "DATE"},
    "TAX_DOCUMENT": {"pan": "ID_NUMBER", "assessment_year": "TEXT", "tax_payable": "CURRENCY", "gross_income": "CURRENCY", "filing_date": "DATE"},
    "RESUME": {"candidate_name": "NAME", "email": "TEXT", "phone": "ID_NUMBER", "education": "LIST", "skills": "LIST", "experience": "LIST"},
    "PASSPORT": {"passport_number": "ID_NUMBER", "full_name": "NAME", "nationality": "TEXT", "date_of_birth": "DATE", "place_of_birth": "TEXT", "issue_date": "DATE", "expiry_date": "DATE"},
    "UTILITY_BILL": {"provider_name": "NAME", "consumer_number": "ID_NUMBER", "bill_date": "DATE", "due_date": "DATE", "total_amount": "CURRENCY", "consumer_address": "ADDRESS"},
    "PROPERTY_DOCUMENT": {"document_type": "TEXT", "property_address": "ADDRESS", "buyer_tenant_name": "NAME", "seller_landlord_name": "NAME", "transaction_value": "CURRENCY", "execution_date": "DATE"},
    "TRANSPORT_DOCUMENT": {"document_type": "TEXT", "registration_number": "ID_NUMBER", "holder_name": "NAME", "vehicle_class": "TEXT", "issue_date": "DATE", "validity": "DATE"},
    "FINANCIAL_REPORT": {"company_name": "NAME", "report_type": "TEXT", "financial_year": "TEXT", "total_revenue": "CURRENCY", "net_profit": "CURRENCY", "auditor_name": "NAME"},
    "UNKNOWN": {"document_title": "TEXT", "date": "DATE", "reference_number": "ID_NUMBER", "key_entity": "NAME", "summary": "TEXT"},
}
