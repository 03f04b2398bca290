-- Product search: the first 500 products by name whose name matches :pattern,
-- optionally in one department (NULL: any), then the reorders of those only.
WITH found AS (
    SELECT p.product_id, p.product_name, a.aisle, d.department
    FROM products AS p
    INNER JOIN aisles AS a USING (aisle_id)
    INNER JOIN departments AS d USING (department_id)
    WHERE p.product_name ILIKE :pattern
      AND d.department = coalesce(:department, d.department)
    ORDER BY p.product_name NULLS LAST, p.product_id NULLS LAST
    LIMIT 500
),
sums AS (
    SELECT product_id, sum(reordered) AS reorders
    FROM order_details
    WHERE product_id IN (SELECT product_id FROM found)
    GROUP BY product_id
)
SELECT found.*, CAST(coalesce(sums.reorders, 0) AS BIGINT) AS total_reorders
FROM found
LEFT JOIN sums USING (product_id)
ORDER BY product_name NULLS LAST, product_id NULLS LAST
