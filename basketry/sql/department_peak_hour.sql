-- Department summary with its busiest hour, in one pass over the order lines:
-- sums per (department, hour) serve both the totals and the choice of the hour.
-- Lines without an order count as sold but for no hour; of equally busy hours
-- the earliest wins.  The percentage is rounded half up in integers, as a
-- decimal division keeps only 6 places in Spark and would round twice.
WITH by_hour AS (
    SELECT department_id,
           order_hour_of_day AS hour,
           count(*) AS items,
           sum(reordered) AS reorders,
           count(placed.order_id) AS placed
    FROM order_details
    INNER JOIN products USING (product_id)
    LEFT JOIN orders AS placed USING (order_id)
    GROUP BY ALL
),
summary AS (
    SELECT department_id,
           sum(items) AS items_sold,
           sum(reorders) AS reorders,
           min_by(hour, struct(-placed, hour IS NULL, hour)) FILTER (WHERE placed > 0) AS peak_hour,
           sum(placed) AS placed
    FROM by_hour
    GROUP BY department_id
)
SELECT department,
       items_sold,
       CAST((20000 * reorders + items_sold) DIV (2 * items_sold) AS DOUBLE) / 100 AS reorder_pct,
       peak_hour
FROM summary
INNER JOIN departments USING (department_id)
WHERE placed > 0
ORDER BY items_sold DESC, department;
