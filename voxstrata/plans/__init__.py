"""Plan building blocks shared by operators: durable tables and graph fixpoints."""
