"""Recognised pages as token rows, made from the order table: a heading, labelled values and a small table.

Moduli shift boxes, misspell captions, put values below their labels and leave tokens out. The
view text is common to Spark SQL and DuckDB. Boxes are left, top, width, height.
"""

TOKENS = """
SELECT k AS doc_id, 1 AS page, tid, CASE tid
    WHEN 0 THEN CASE k % 4 WHEN 0 THEN 'COMMERCIAL INVOICE' WHEN 1 THEN 'PACKING LIST' WHEN 2 THEN 'BILL OF LADING' ELSE 'NOTICE' END
    WHEN 1 THEN CASE WHEN k % 9 = 0 THEN 'Invoise Number' ELSE 'Invoice Number' END WHEN 2 THEN 'INV-' || CAST(k AS STRING)
    WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 'Total Amount: ' || CAST(100 + k % 900 AS STRING) ELSE 'Total Amount' END WHEN 4 THEN CAST(100 + k % 900 AS STRING) || '.50 USD'
    WHEN 5 THEN CASE WHEN k % 6 = 0 THEN 'Gros Weight' ELSE 'Gross Weight' END WHEN 6 THEN CAST(k % 97 AS STRING) || '.5 KG'
    WHEN 7 THEN 'Description' WHEN 8 THEN 'Quantity' WHEN 9 THEN 'Net Weight' WHEN 10 THEN 'Brass hinge' WHEN 11 THEN CAST(1 + k % 24 AS STRING) WHEN 12 THEN CAST(k % 13 AS STRING) || '.25 KG'
    WHEN 13 THEN 'Steel bolt' WHEN 14 THEN CAST(2 + k % 30 AS STRING) WHEN 15 THEN CAST(k % 17 AS STRING) || '.75 KG' ELSE '12 Mar 2025' END AS text,
  x, CASE WHEN tid = 6 AND k % 7 = 0 THEN y + 30 ELSE y END AS y, w, h, CASE WHEN (k + tid) % 29 = 0 THEN 0.55 ELSE 0.97 END AS confidence
FROM (SELECT o_orderkey AS k, tid, x, y, w, h FROM {orders} CROSS JOIN (VALUES (0, 20.0, 20.0, 300.0, 30.0), (1, 20.0, 100.0, 140.0, 18.0), (2, 200.0, 101.0, 120.0, 18.0), (3, 20.0, 140.0, 140.0, 18.0), (4, 200.0, 139.0, 120.0, 18.0),
  (5, 20.0, 180.0, 140.0, 18.0), (6, 200.0, 181.0, 90.0, 18.0), (7, 20.0, 300.0, 220.0, 18.0), (8, 330.0, 300.0, 140.0, 18.0), (9, 520.0, 301.0, 140.0, 18.0), (10, 20.0, 340.0, 200.0, 18.0), (11, 332.0, 341.0, 50.0, 18.0),
  (12, 524.0, 340.0, 100.0, 18.0), (13, 20.0, 380.0, 200.0, 18.0), (14, 331.0, 379.0, 50.0, 18.0), (15, 522.0, 380.0, 100.0, 18.0), (16, 500.0, 24.0, 120.0, 18.0)) AS t(tid, x, y, w, h)) AS o
WHERE NOT (tid = 4 AND k % 11 = 0)
"""
#: Own vocabulary: captions (lower case, letters alone) and the field each names.
VOCABULARY = {
    "invoicenumber": "invoice_number", "invoiceno": "invoice_number", "totalamount": "total_amount", "grossweight": "gross_weight", "netweight": "net_weight", "description": "description", "quantity": "quantity", "qty": "quantity",
    "portofloading": "port_of_loading", "portofdischarge": "port_of_discharge", "vesselname": "vessel", "shippername": "shipper",
}
HEADINGS = {"commercial_invoice": r"(?i)^(?:commercial )?invoice$", "packing_list": r"(?i)^packing list$", "bill_of_lading": r"(?i)^bill of lading$"}

#: Forms that show what captions and values do beside each other: a title with its number, paired quantity columns, counts of packages, a unit
#: column, parties in one line, a caption on two lines, a total with its volume, a unit parted over captions. Moduli of the order key vary each.
FORMS = """
SELECT k AS doc_id, 1 AS page, tid, CASE tid
    WHEN 0 THEN CASE k % 5 WHEN 0 THEN 'Bill of Lading - Terms and Conditions' WHEN 1 THEN 'COMMERCIAL INVOICE' WHEN 2 THEN 'PACKING LIST' WHEN 3 THEN 'Commercial Invoice: Terms & Conditions' ELSE 'Remarks' END
    WHEN 1 THEN CASE WHEN k % 10 = 3 THEN 'BILL OF LADING' ELSE 'Copy' END WHEN 2 THEN '# INV-' || CAST(k AS STRING) WHEN 3 THEN '# 2'
    WHEN 10 THEN CASE WHEN k % 3 = 0 THEN 'Quantity Ordered' ELSE 'Quantity' END WHEN 11 THEN 'Ordered' WHEN 12 THEN 'Qty' WHEN 13 THEN CASE WHEN k % 8 = 0 THEN 'Ordered' ELSE 'Shipped' END WHEN 14 THEN 'shipped'
    WHEN 20 THEN CASE k % 4 WHEN 1 THEN 'No. of Packages received' WHEN 2 THEN 'Number of Cartons: 5' ELSE 'No. of Pkgs' END WHEN 21 THEN 'Marks' WHEN 22 THEN CASE WHEN k % 5 = 2 THEN 'Notes' ELSE 'Gross Weight' END
    WHEN 23 THEN CASE WHEN k % 6 = 0 THEN '12' ELSE CAST(1 + k % 40 AS STRING) || ' CTNS' END
    WHEN 30 THEN 'Unit' WHEN 31 THEN CASE WHEN k % 3 = 0 THEN 'Description' ELSE 'Sundry' END WHEN 32 THEN CASE WHEN k % 4 = 0 THEN 'PCS' ELSE CAST(1 + k % 30 AS STRING) || ' PCS' END
    WHEN 40 THEN CASE k % 4 WHEN 0 THEN 'Shipper ACME ' || CAST(k AS STRING) || ' Trading' WHEN 1 THEN 'Shipper shall notify the agent' WHEN 2 THEN 'Consignee BETA ' || CAST(k AS STRING) || ' notify party BETA' ELSE 'Shipper and shipper ACME' END
    WHEN 50 THEN CASE k % 5 WHEN 0 THEN 'see Port of' WHEN 1 THEN '3. Port of' ELSE 'Port of' END
    WHEN 51 THEN CASE k % 4 WHEN 1 THEN 'Discharge BUSAN ' || CAST(k % 9 AS STRING) WHEN 2 THEN 'Registry: PANAMA' ELSE 'Loading: BUSAN ' || CAST(k % 9 AS STRING) END
    WHEN 60 THEN 'Brass hinge' WHEN 61 THEN 'Total Gross Weight: ' || CAST(100 + k % 900 AS STRING) || ' KG' WHEN 62 THEN CAST(1 + k % 9 AS STRING) || '.5 CBM' WHEN 63 THEN '4 m3'
    WHEN 80 THEN CASE k % 3 WHEN 0 THEN 'Weight (K' WHEN 1 THEN 'Weight (KG' ELSE 'Weight' END WHEN 81 THEN CASE k % 3 WHEN 0 THEN 'G)' WHEN 1 THEN 'or LB)' ELSE 'total' END END AS text,
  CASE WHEN tid = 2 THEN 308.0 + 30.0 * (k % 4) WHEN tid = 11 AND k % 6 = 1 THEN 90.0 WHEN tid = 51 AND k % 4 = 3 THEN 70.0 WHEN tid = 62 AND k % 4 = 3 THEN 400.0 ELSE x END AS x, CASE WHEN tid = 61 AND k % 6 = 5 THEN 705.0 ELSE y END AS y, w, 18.0 AS h
FROM (SELECT o_orderkey AS k, tid, x, y, w FROM {orders} CROSS JOIN (VALUES (0, 20.0, 20.0, 300.0), (1, 20.0, 50.0, 150.0), (2, 0.0, 21.0, 90.0), (3, 345.0, 22.0, 30.0), (10, 20.0, 100.0, 80.0), (11, 25.0, 118.0, 60.0), (12, 200.0, 100.0, 60.0), (13, 205.0, 120.0, 50.0),
  (14, 207.0, 122.0, 46.0), (20, 20.0, 160.0, 90.0), (21, 150.0, 161.0, 60.0), (22, 300.0, 162.0, 100.0), (23, 25.0, 190.0, 60.0), (30, 20.0, 360.0, 50.0), (31, 150.0, 360.0, 100.0), (32, 22.0, 390.0, 60.0), (40, 20.0, 560.0, 200.0),
  (50, 20.0, 600.0, 60.0), (51, 22.0, 620.0, 110.0), (60, 20.0, 680.0, 200.0), (61, 20.0, 740.0, 240.0), (62, 200.0, 770.0, 60.0), (63, 210.0, 790.0, 40.0), (80, 20.0, 840.0, 80.0), (81, 110.0, 840.0, 60.0)) AS t(tid, x, y, w)) AS o
WHERE NOT (tid = 3 AND k % 7 <> 0) AND NOT (tid = 11 AND k % 3 = 0) AND NOT (tid = 14 AND k % 9 <> 0) AND NOT (tid = 63 AND k % 5 <> 0)
"""
FORM_VOCABULARY = {
    "quantity": "quantity", "qty": "quantity", "marks": "marks", "grossweight": "gross_weight", "description": "description", "unit": "unit", "productcode": "product_code", "netweight": "net_weight", "volume": "volume",
}
#: Captions of several words, for captions that run over two lines.
TERMS = {"port_of_loading": "port of loading", "port_of_discharge": "port of discharge", "bill_of_lading_number": "bill of lading number"}
