"""tarn: a versioned lakehouse table engine on PySpark."""
