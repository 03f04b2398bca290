-- Product search with an hour band: the first 500 products by name whose name
-- matches :pattern, optionally in one department (NULL: any), their reorders at
-- any hour, and their lines in orders placed from :from_hour to :to_hour.  The
-- band stands in the join condition, so it removes no line and no product.
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
    SELECT l.product_id, sum(l.reordered) AS reorders, count(o.order_id) AS band_lines
    FROM order_details AS l
    LEFT JOIN orders AS o
        ON o.order_id = l.order_id AND o.order_hour_of_day BETWEEN :from_hour AND :to_hour
    WHERE l.product_id IN (SELECT product_id FROM found)
    GROUP BY l.product_id
)
SELECT found.*, CAST(coalesce(sums.reorders, 0) AS BIGINT) AS total_reorders,
       CAST(coalesce(sums.band_lines, 0) AS BIGINT) AS band_lines
FROM found
LEFT JOIN sums USING (product_id)
ORDER BY product_name NULLS LAST, product_id NULLS LAST
