"""The question shapes a question can be routed to: recipe function, title, and sample questions."""

SHAPES = (
    ("total_by_category", "Sum of a number for each group",
     "total revenue by return flag; total price of orders by region; total quantity by supplier nation"),
    ("mean_by_category", "Mean of a number for each group",
     "average account balance by region; average order price for each priority; average cost for each supplier"),
    ("ratio_by_category", "One total over another for each group",
     "ratio of tax to price by line status; highest ratio of balance to orders by segment; revenue over quantity by brand"),
    ("top_rows", "The largest rows",
     "top 10 orders by price; ten largest orders; five customers with most balance"),
    ("correlation", "How two numbers move together",
     "correlation of quantity with extended price; correlation between part size and retail price; do tax and discount correlate"),
    ("counts_shares", "How many rows fall in each group",
     "count of orders by status; number of parts by type; how many customers in every segment"),
    ("over_time", "A number along the calendar",
     "monthly trend of shipped quantity; revenue trend along the order date; events by week"),
    ("compare_groups", "Two groups side by side",
     "compare returned lines with kept lines; do urgent orders cost more than others; compare balances of two segments"),
    ("distinct_per_category", "Different items within each group",
     "unique customers by status; distinct suppliers by nation; different parts by brand"),
    ("filter_aggregate", "A total under a condition",
     "total price only where the priority is urgent; only lines with a discount; quantity where flag equals R"),
    ("share_of_total", "Each group as a percentage of the whole",
     "percentage of revenue that comes from each ship mode; percentage of total price by segment; share of all quantity by brand"),
    ("missing_by_column", "Empty cells of each column",
     "nulls in each column of the customer table; count of null cells by column; missing values of orders"),
    ("outlier_rows", "Rows with extreme numbers",
     "outliers in the extended price column; outliers of account balance; extreme order amounts"),
    ("crosstab", "A table of two groupings",
     "cross tabulate status against priority; matrix of segment against nation; pivot flag by line status"),
    ("period_change", "Growth from one period to the next",
     "year over year growth of revenue; change of order count against the previous month; growth from quarter to quarter"),
    ("rate_by_category", "How often something is true in each group",
     "return rate by region of the supplier; rate of late orders by priority; rate of failed events by type"),
    ("top_groups", "The groups that rank highest",
     "which nations have the highest average balance; which suppliers have the highest total price; which brands rank first by revenue"),
    ("by_bands", "A number across ranges of another number",
     "average price by quantity group; average discount by age group of the order; tax across balance bands"),
    ("distribution", "How the values of a number spread",
     "distribution of account balances; spread of order prices; histogram of discounts"),
    ("two_categories", "A number for each pair of groups",
     "price by status and priority; quantity varies by flag and quarter; revenue by brand and type together"),
    ("mode_per_category", "The most frequent value in each group",
     "most common priority across segments; most common event across users; usual part size across brands"),
    ("driver_effect", "What influences a number",
     "does segment affect order price; how does discount affect quantity levels; effect of priority on revenue"),
    ("difference_ci", "Whether two groups truly differ",
     "is the difference in price between returned and kept lines real; is the gap between two segments significant; confidence interval of a difference"),
)
