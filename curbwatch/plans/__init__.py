"""Plans that wire operators to tables: fixtures, scoring, API views and the query registry."""
