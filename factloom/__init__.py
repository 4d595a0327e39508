"""factloom: fact-graph analytics and corpus preparation as Spark DataFrame operators."""
